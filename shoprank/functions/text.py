"""String column helpers with Python string semantics where results must match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space removed by Python's str.strip(), as a regex class that Java and RE2 both read.
WS_CLASS = (r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
_STRIP_RE = rf"^{WS_CLASS}+|{WS_CLASS}+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``s.strip()`` (Spark's trim removes spaces only)."""
    return F.regexp_replace(_col(c), _STRIP_RE, "")


def first_labelled_value(body, label: str, parity: bool = True) -> Column:
    """Value of the first line that contains ``label`` (case-insensitive), label removed.

    parity=True reproduces the original exactly: the removal of ``label + ':'`` is
    case-sensitive (a capitalised label stays in the value). parity=False removes the
    label case-insensitively. No matching line -> ''.
    """
    lines = F.split(py_strip(body), "\n")
    hit = F.try_element_at(F.filter(lines, lambda ln: F.lower(ln).contains(label)), F.lit(1))
    if parity:
        removed = F.replace(hit, F.lit(label + ":"), F.lit(""))
    else:
        removed = F.regexp_replace(hit, "(?i)" + label + ":", "")
    return F.coalesce(py_strip(removed), F.lit(""))


def float_repr(c) -> Column:
    """Python ``str(float(x))`` of a FLOAT column (the value as a double), NULL -> 'N/A'.

    Plain decimals from 1e-4 up to 1e16 and ``1e-05`` / ``1e+16`` outside; the digits are the engine's shortest ones.
    """
    x = _col(c).cast("double")
    s = x.cast("string")
    sign = F.when(s.startswith("-"), "-").otherwise("")
    mant = F.regexp_extract(s, r"^-?([0-9.]+)E", 1)
    exp = F.regexp_extract(s, r"E(-?[0-9]+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.replace(mant, F.lit("."), F.lit("")), "0+$", "")
    digits = F.when(digits == "", "0").otherwise(digits)
    n = F.length(digits)
    large = F.when(n <= exp + 1, F.concat(F.rpad(digits, exp + 1, F.lit("0")), F.lit(".0"))).otherwise(
        F.concat(F.substring(digits, F.lit(1), exp + 1), F.lit("."), F.substring(digits, exp + 2, n)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    far = F.concat(F.regexp_replace(mant, r"\.0$", ""), F.lit("e"), F.when(exp < 0, "-").otherwise("+"),
                   F.lpad(F.abs(exp).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exp).cast("string"))), F.lit("0")))
    text = (F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf"))).when(F.instr(s, "E") == 0, s)
            .when(exp.between(0, 15), F.concat(sign, large)).when(exp.between(-4, -1), F.concat(sign, small))
            .otherwise(F.concat(sign, far)))
    return F.when(x.isNull(), F.lit("N/A")).otherwise(text)


def fixed_decimals(c, pattern: str) -> Column:
    """Python ``f'{x:.Nf}'`` via a DecimalFormat pattern ('0.00'); NULL -> 'N/A'."""
    return F.coalesce(F.call_function("format_number", _col(c).cast("double"), F.lit(pattern)), F.lit("N/A"))


def normalize_keywords(c) -> Column:
    """Lower-case, split on commas, strip, drop empties, de-duplicate keeping first order."""
    parts = F.transform(F.split(F.lower(_col(c)), ","), lambda x: py_strip(x))
    parts = F.filter(parts, lambda x: F.length(x) > 0)
    return F.array_join(F.array_distinct(parts), ", ")

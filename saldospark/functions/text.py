"""Column functions over text and amounts. All are native expressions; patterns spell out Unicode behaviour."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from saldospark.rules.special import MONTHS


def strip(c: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def matches(c: Column, pattern: str) -> Column:
    """A case-insensitive search with Unicode word boundaries."""
    return c.rlike("(?iU)" + pattern)


def contains_any(c: Column, words: Iterable[str]) -> Column:
    return reduce(Column.__or__, [c.contains(w) for w in words])


def normalize_name(c: Column) -> Column:
    """Lower case, letters, digits and underscores of any script, single blanks."""
    plain = F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}_\s]", " ")
    return strip(F.regexp_replace(plain, r"(?U)\s+", " "))


def title_case(c: Column) -> Column:
    """A capital at the start of each run of letters, lower case elsewhere."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), "")


def pad2(c: Column) -> Column:
    """At least two digits; longer values stay (``lpad`` would cut them)."""
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def normalize_date(c: Column) -> Column:
    """dd/mm/yyyy from three parts between / - or .; anything else is only stripped."""
    t = strip(c)
    p = F.split(t, r"[/\-.]")
    year = F.when(F.length(p[2]) == 2, F.concat(F.lit("20"), p[2])).otherwise(p[2])
    return F.when(F.size(p) == 3, F.concat_ws("/", pad2(p[0]), pad2(p[1]), year)).otherwise(t)


def month_number(c: Column) -> Column:
    """Two digits of a Spanish month name; unknown names count as December."""
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02d}")])
    return F.coalesce(F.try_element_at(months, F.lower(c)), F.lit("12"))


def fix_ocr_zero(c: Column) -> Column:
    return F.when(c.isin("o", "O"), F.lit("0")).otherwise(c)


def fix_ocr_code(c: Column) -> Column:
    """Commas in a leading dotted code (before white space) become dots."""
    head = F.regexp_extract(c, r"^((?:\d{1,2}[.,]){2,4}\d{1,2})(?=\s)", 1)
    return F.when(head != "", F.concat(F.translate(head, ",", "."), F.substr(c, F.length(head) + 1))).otherwise(c)


def parse_amount(c: Column, thousands: Column | str, bare: bool = False) -> Column:
    """A double from an amount with the given thousands separator; null where it isn't one.

    Parentheses or a leading minus negate, both together once; after one leading minus a second one is the number's own.
    ``bare`` says that the amount has no white space.
    """
    sep = F.lit(thousands) if isinstance(thousands, str) else thousands
    v = c if bare else F.replace(strip(c), F.lit(" "), F.lit(""))
    wrapped = v.startswith("(") & v.endswith(")")
    inner = F.when(wrapped, F.substr(v, F.lit(2), F.greatest(F.length(v) - 2, F.lit(0)))).otherwise(v)
    minus = inner.startswith("-")
    digits = F.when(minus, F.substr(inner, F.lit(2))).otherwise(inner)
    plain = F.when(sep == ".", F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(digits, F.lit(","), F.lit("")))
    number = F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))
    return F.when(v.isin("", "-"), F.lit(None).cast("double")).when(v.isin("0", "0.00", "0,00"), F.lit(0.0)).otherwise(
        F.when(wrapped | minus, -number).otherwise(number)
    )


def code_format(c: Column) -> Column:
    """Format of a token as the profiler sees it: two separators at least."""
    t = strip(F.coalesce(c, F.lit("")))
    return (
        F.when(t.rlike(r"^\d+(-\d+){2,}$"), F.lit("guion")).when(t.rlike(r"^\d+(\.\d+){2,}$"), F.lit("punto"))
        .when(t.rlike(r"^\d{6,10}$"), F.lit("compacto")).otherwise(F.lit("sin_codigo"))
    )


def loose_code_format(c: Column, bare: bool = False) -> Column:
    """Format of a code as the classifier sees it: one separator is enough. ``bare`` says that the code is stripped and not null."""
    t = c if bare else strip(F.coalesce(c, F.lit("")))
    return (
        F.when(t == "", F.lit("sin_codigo")).when(t.rlike(r"^\d+-\d+"), F.lit("guion")).when(t.rlike(r"^\d+\.\d+"), F.lit("punto"))
        .when(t.rlike(r"^\d{6,10}$"), F.lit("compacto")).otherwise(F.lit("desconocido"))
    )


def separator_vote(c: Column) -> Column:
    """"." or "," for the thousands separator that an amount speaks for, or null."""
    t = strip(c)

    def one(sign: str, regex: str) -> Column:
        p = F.split(t, regex)
        threes = F.forall(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1))), lambda x: F.length(x) == 3)
        decimals = (F.size(p) == 2) & F.length(F.element_at(p, -1)).isin(1, 2)
        return F.when(threes, F.lit(sign)).when(decimals, F.lit(None).cast("string")).otherwise(F.lit(sign))

    dot, comma = t.contains("."), t.contains(",")
    rightmost_dot = F.locate(".", F.reverse(t)) < F.locate(",", F.reverse(t))
    return (
        F.when(t.isin("", "0", "-"), F.lit(None).cast("string"))
        .when(dot & comma, F.when(rightmost_dot, F.lit(",")).otherwise(F.lit(".")))
        .when(dot, one(".", r"\.")).when(comma, one(",", ","))
    )


def token_sort(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, " "), lambda w: w != "")), " ")


def numbered_chars(c: Column) -> Column:
    """The characters of a string, each with its number among equal ones: sets of them intersect as bags of characters do."""
    chars = F.split(c, "")
    return F.transform(chars, lambda x, i: F.concat(x, F.size(F.filter(F.slice(chars, F.lit(1), i), lambda y: y == x)).cast("string")))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two non-empty strings."""
    left, right = F.split(a, ""), F.split(b, "")

    def row(before: Column, ch: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(right)), F.array(F.lit(0)),
            lambda now, j: F.concat(now, F.array(
                F.when(F.element_at(right, j) == ch, F.element_at(before, j) + 1).otherwise(F.greatest(F.element_at(before, j + 1), F.element_at(now, j)))
            )),
        )

    return F.element_at(F.aggregate(left, F.array_repeat(F.lit(0), F.size(right) + 1), row), -1)


def similarity(a: Column, b: Column) -> Column:
    """0 to 100: twice the common subsequence over both lengths (strings with sorted tokens); 0 if one is empty."""
    total = F.length(a) + F.length(b)
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 200.0 * lcs_length(a, b) / total).otherwise(F.lit(0.0))


def base_method(c: Column) -> Column:
    return F.substring_index(c, "+", 1)


def catalog_label(code: Column, name: Column) -> Column:
    """``code — name``, or the code alone where the name is missing."""
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat_ws(" — ", code, name)).otherwise(code)


def money(c: Column) -> Column:
    return F.format_number(c, 0)


def percent(c: Column) -> Column:
    return F.concat(F.format_number(c * 100, 0), F.lit("%"))


def exact(c: Column) -> Column:
    """An amount as DECIMAL(20,2), so that sums don't depend on their order."""
    return c.cast("decimal(20,2)")

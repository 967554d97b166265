"""Fill-in-the-middle examples: a text is cut at two unit boundaries and its parts are put in another order.

``regexp_count`` gives the number of units. A pattern made for the row, ``(unit{a})(unit{b - a})(rest)`` with possessive
counts, matches the whole text once and fills the arranged output from its groups. Possessive counts are loops
inside the matcher, so a text of millions of units needs no stack and no way back.

Defined results: null texts count as empty; an empty text and one that holds a marker stay plain; a null doc_id counts
as an empty one; equal rows give equal results; an empty table gives an empty one. Columns of ``docs`` other than
``doc_id`` and ``text`` are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
POSSESSIVE_UNIT = "(?:[A-Za-z]++|[^A-Za-z])"
MARKERS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
SEED, ARRANGED, SUFFIX_FIRST = 1, 90, 20  # percent of texts that are cut; percent of those with the suffix first


def _draw(seed: int, i: int) -> Column:
    """The ``i``-th group of eight hex digits of the row's hash, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def _literal(marker: str) -> str:
    """A marker as part of a replacement."""
    return marker.replace("\\", "\\\\").replace("$", "\\$")


def _quoted(marker: str) -> str:
    return "\\Q" + marker + "\\E"


def _checked(markers: tuple[str, str, str]) -> None:
    """Parts are told apart again only if no marker can begin inside another one."""
    heads = {m[:1] for m in markers}
    if len(set(markers)) < 3 or "" in heads or any(h in m[1:] for m in markers for h in heads) or any("\\E" in m for m in markers):
        raise ValueError(f"markers must differ, and their first characters stand nowhere else in them: {markers}")


def fill_in_middle(docs: DataFrame, seed: int = SEED, arranged: int = ARRANGED, suffix_first: int = SUFFIX_FIRST, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``doc_id, n, form, output, prefix_chars, middle_chars``: units, ``plain``, ``psm`` or ``spm``, and the arranged text.

    Both cuts come from the hash of seed and doc_id, anywhere from before the first to behind the last of the units.
    """
    _checked(markers)
    p, s, m = markers
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), *[_draw(seed, i).alias(f"h{i + 1}") for i in range(4)])
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    for name, pick in (("a", F.least), ("b", F.greatest)):
        rows = rows.withColumn(name, pick(F.expr("h1 % (n + 1)"), F.expr("h2 % (n + 1)")))
    marked = F.lit(False)
    for marker in markers:
        marked = marked | F.contains("text", F.lit(marker))
    form = F.when((F.col("n") == 0) | marked | (F.col("h3") % 100 >= arranged), "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)

    def times(count: Column) -> list[Column]:
        return [F.lit(f"({POSSESSIVE_UNIT}{{"), count.cast("string"), F.lit("}+)")]

    pattern = F.concat(F.lit("(?s)\\A"), *times(F.col("a")), *times(F.col("b") - F.col("a")), F.lit("(.*)\\z"))
    psm = f"{_literal(p)}$1{_literal(s)}$3{_literal(m)}$2"
    spm = f"{_literal(s)}$3{_literal(p)}$1{_literal(m)}$2"
    plain = F.col("form") == "plain"
    order = F.when(F.col("form") == "psm", psm).otherwise(spm)
    rows = rows.withColumn("output", F.when(plain, F.col("text")).otherwise(F.regexp_replace("text", pattern, order)))

    def behind(marker: str) -> Column:
        """Characters up to and with the marker, which stands in an arranged output once."""
        return F.instr("output", F.lit(marker)) + len(marker) - 1

    whole = F.char_length("output")
    prefix = F.when(F.col("form") == "psm", behind(s) - len(s) - len(p)).otherwise(behind(m) - len(m) - behind(p))
    return rows.select(
        "doc_id",
        "n",
        "form",
        "output",
        F.when(~plain, prefix).cast("long").alias("prefix_chars"),
        F.when(~plain, whole - behind(m)).cast("long").alias("middle_chars"),
    )


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text behind an output of ``fill_in_middle``, from the output and its form alone."""
    _checked(markers)
    p, s, m = map(_quoted, markers)
    psm = F.regexp_replace(output, F.lit(f"(?s)\\A{p}(.*?){s}(.*?){m}(.*)\\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(f"(?s)\\A{s}(.*?){p}(.*?){m}(.*)\\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

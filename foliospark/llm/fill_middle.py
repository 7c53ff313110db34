"""Fill-in-middle transformation: a per-row pattern with counted possessive groups cuts each text in one match."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.shared import table, text_of

#: A line with its end, or the rest of the text.
LINE = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Markers:
    """The strings before the three parts. No part may hold one, so a text that does stays plain."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        # in this form no marker can arise where a part and a marker meet
        if len(found := {self.prefix, self.suffix, self.middle}) < 3 or not all(re.fullmatch(r"<\w+>", m) for m in found):
            raise ValueError("markers must be three different strings of the form <name>")

    def found_in(self, text: Column) -> Column:
        return F.contains(text, F.lit(self.prefix)) | F.contains(text, F.lit(self.suffix)) | F.contains(text, F.lit(self.middle))


def draws(id_: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a row: the first groups of eight digits of the SHA-256 of seed:id. A null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def counted_pattern(unit: str, first: Column, second: Column) -> Column:
    """A pattern whose groups are `first` units, `second` units and the rest of the text.

    Possessive counted groups are matched in a loop without a way back, so neither many units nor
    long ones cost stack or time.
    """
    return F.concat(
        F.lit(rf"\A((?:{unit}){{"), first.cast("string"), F.lit(rf"}}+)((?:{unit}){{"), second.cast("string"), F.lit(r"}+)((?s:.*))\z"),
    )


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINE, seed: int = 7, percent: int = 100, spm_percent: int = 50,
    markers: Markers = Markers(),
) -> DataFrame:
    """Every text as prefix, suffix and middle, cut at two borders between units drawn by a hash of the id.

    unit is a regular expression of which every text is a sequence. Of n units the borders are two
    draws modulo n + 1; `percent` of the rows are transformed, `spm_percent` of those with the
    suffix first. Returns id_col, n (long), form (psm, spm or plain) and output (the text for
    training); an id column named like one of these is an error.

    One pass without a shuffle. Null texts are empty; empty texts and those that hold a marker
    stay plain; a null id is drawn like an empty one; repeated ids get the same draws and repeated
    rows the same output; an empty table gives an empty result; other columns aren't read.
    """
    if id_col in ("n", "form", "output"):
        raise ValueError(f"{id_col} is a column of the result")
    text = F.col("_text")
    h1, h2, h3, h4 = (F.col(f"_h{k}") for k in range(4))
    m = markers
    plain = (text == "") | m.found_in(text) | (h3 % 100 >= percent)
    low, high = F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)), F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1))
    order = F.when(F.col("form") == "spm", F.lit(f"{m.suffix}$3{m.prefix}$1{m.middle}$2")).otherwise(F.lit(f"{m.prefix}$1{m.suffix}$3{m.middle}$2"))
    drawn = docs.select(F.col(id_col), text_of(text_col).alias("_text"), *[h.alias(f"_h{k}") for k, h in enumerate(draws(F.col(id_col), seed))])
    return (
        drawn.withColumn("n", F.regexp_count(text, F.lit(unit)).cast("long"))
        .withColumn("form", F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm"))
        .withColumn("_pattern", counted_pattern(unit, low, high - low))
        .select(id_col, "n", "form", F.when(F.col("form") == "plain", text).otherwise(F.regexp_replace(text, F.col("_pattern"), order)).alias("output"))
    )


def parts_of(output: Column, form: Column, markers: Markers = Markers()) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix read from an output that isn't plain; null where it is."""
    m = markers
    first, second = F.when(form == "spm", m.suffix).otherwise(m.prefix), F.when(form == "spm", m.prefix).otherwise(m.suffix)
    one, two, three = F.length(first) + 1, F.call_function("locate", second, output), F.call_function("locate", F.lit(m.middle), output)
    a, b = F.substr(output, one, two - one), F.substr(output, two + F.length(second), three - two - F.length(second))
    middle = F.substr(output, three + len(m.middle))
    made = form != "plain"
    return F.when(made, F.when(form == "spm", b).otherwise(a)), F.when(made, middle), F.when(made, F.when(form == "spm", a).otherwise(b))


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text that fill_in_middle made `output` of."""
    prefix, middle, suffix = parts_of(output, form, markers)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    prefix, middle, _ = parts_of(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", F.char_length(prefix).cast("long").alias("prefix_chars"), F.char_length(middle).cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES = {"op13_fill_middle": op13_fill_middle}
ORACLE_SQL = {
    "op13_fill_middle": r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), g AS (
    SELECT doc_id, text, units, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g
), p AS (
    SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256 FROM p
""",
}

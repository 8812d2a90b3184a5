"""Fill-in-the-middle documents by escaped marker injection, with column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import free_name

#: Ends each unit while a text is cut. Texts that hold it or the escape themselves have both escaped first.
DELIMITER, ESCAPE = "\x01", "\x02"
#: A unit of an escaped text: an escaped character, a run of letters, or any other code point.
_UNIT = ESCAPE + r"[12]|[A-Za-z]++|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Hundredths of documents that are cut, and of these the ones whose suffix comes first.
FIM_PERCENT, SPM_PERCENT = 90, 20
SEED = 1


def escaped(text: Column) -> Column:
    """The text without DELIMITER; every unit stays one unit."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "2")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))


def unescaped(text: Column) -> Column:
    """What was escaped, without the delimiters between units."""
    bare = F.replace(text, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "2"), F.lit(ESCAPE))


def marked(text: Column) -> Column:
    """The escaped text with DELIMITER after each unit."""
    return F.regexp_replace(escaped(text), f"({_UNIT})", f"$1{DELIMITER}")


def unit_count(marks: Column) -> Column:
    return (F.char_length(marks) - F.char_length(F.replace(marks, F.lit(DELIMITER), F.lit("")))).cast("long")


def _units(marks: Column, count: Column) -> Column:
    """The first `count` units of a marked text, or what follows the last so many delimiters if count is negative."""
    return F.call_function("substring_index", marks, F.lit(DELIMITER), count)


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2**32 that an id and the seed decide."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made of.

    Texts that hold a marker are never cut, and a marker can't begin inside another, so each one's first place is its own.
    """
    at = lambda marker: F.locate(marker, output)
    between = lambda low, high: F.substring(output, low + 3, high - low - 3)
    end = F.char_length(output) + 1
    prefix = F.when(form == "psm", between(at(PREFIX), at(SUFFIX))).otherwise(between(at(PREFIX), at(MIDDLE)))
    suffix = F.when(form == "psm", between(at(SUFFIX), at(MIDDLE))).otherwise(between(at(SUFFIX), at(PREFIX)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, between(at(MIDDLE), end), suffix))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED) -> DataFrame:
    """docs with fim_n, fim_form, fim_prefix, fim_middle, fim_suffix and fim_output; other columns, whatever their names, unchanged.

    A text is cut into units (a run of letters A-Z, or any other code point) at two places that a hash of the seed and
    the id decides: the first of the two ends the prefix, the other the middle. Form `psm` puts prefix, suffix and
    middle in this order, each after its marker, `spm` the suffix first; a text that is empty, holds a marker, or falls
    outside fim_percent is `plain` and its output is itself, with null parts. spm_percent of the others are spm.

    Each row is worked on by itself, in memory of a few times its text, without a shuffle; nothing ends a document but
    its own end. Null texts count as empty, a null id as the empty string in the hash; rows that share an id share
    their draws, and repeated rows stay as they are. Empty tables give empty results. Columns of the added names are replaced.
    """
    names = {x: free_name(docs, f"lw_{x}") for x in ("text", "marks", "n", "low", "high", "form")}
    text, marks, n, low, high, form = (F.col(x) for x in names.values())
    one, two, three, four = draws(F.col(f"`{id_col}`"), seed)
    holds = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        holds = holds | F.contains(text, F.lit(m))
    cut = docs.withColumn(names["text"], F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    cut = cut.withColumn(names["marks"], marked(text)).withColumn(names["n"], unit_count(marks))
    ends = (one % (n + 1), two % (n + 1))
    plain = (text == "") | holds | (three % 100 >= fim_percent)
    cut = cut.withColumns({
        names["low"]: F.least(*ends).cast("int"), names["high"]: F.greatest(*ends).cast("int"),
        names["form"]: F.when(plain, "plain").when(four % 100 < spm_percent, "spm").otherwise("psm"),
    })
    head = _units(marks, high)
    parts = {
        "fim_prefix": _units(marks, low),
        # The middle is the last units of the head; the suffix is what follows the last delimiter but so many.
        "fim_middle": _units(head, low - high),
        "fim_suffix": _units(marks, (high - n - 1).cast("int")),
    }
    cut = cut.withColumns({k: F.when(form != "plain", unescaped(v)) for k, v in parts.items()})
    prefix, middle, suffix = (F.col(k) for k in parts)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    cut = cut.withColumns({"fim_n": n, "fim_form": form, "fim_output": F.when(form == "plain", text).when(form == "psm", psm).otherwise(spm)})
    return cut.drop(*names.values())


#: The transformation in DuckDB's SQL, by lists of units.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units,
         ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT doc_id, t, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

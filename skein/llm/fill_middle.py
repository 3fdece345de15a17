"""Fill-in-middle transformation of texts held as ropes.

A text is split at two unit ranks, and its three parts are joined in another order behind sentinels; the inverse finds the sentinels
and splits there. Trees take the place of copies: each part is a subtree. Ranks and forms come from a hash of the document's id, so any
run, and any executor that takes a lost one's place, gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from skein.llm import rope
from skein.llm.store import bound_batches
from skein.llm.textkit import chunks, column

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Sentinels in the order of a form's output, each before the part that it names.
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of the SHA-256 of `seed:doc_id`."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output for each row of docs (doc_id, text).

    The text is plain (form `plain`, output the text, no parts) if it is empty, holds a sentinel, or is not among `rate` percent; else spm for `spm_rate` percent and psm
    for the rest. Prefix and middle end after the smaller and the larger of two ranks from 0 to n, either of which may be empty. Null text is empty; a null doc_id is drawn
    for as an empty one; rows of one doc_id and text are alike; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    one, two, three, four = _draws(F.col("doc_id"), seed)
    marked = F.lit(False)
    for s in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(s))
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    form = F.when((F.col("text") == "") | marked | (three % 100 >= rate), "plain").when(four % 100 < spm_rate, "spm").otherwise("psm")
    drawn = text.select("doc_id", "text", one.alias("one"), two.alias("two"), form.alias("form"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            n, prefix, middle, out = [], [], [], []
            for text, a, b, form in zip(*(column(batch, c).to_pylist() for c in ("text", "one", "two", "form")), strict=True):
                whole = rope.build(text.encode())
                n.append(whole.units)
                if form == "plain":
                    prefix.append(None)
                    middle.append(None)
                    out.append(text)
                    continue
                low, high = sorted((a % (whole.units + 1), b % (whole.units + 1)))
                head, s = rope.split_units(whole, high)
                p, m = rope.split_units(head, low)
                part = {PREFIX: p, SUFFIX: s, MIDDLE: m}
                prefix.append(p.chars)
                middle.append(m.chars)
                out.append(rope.text_of(rope.join(*[r for mark in ORDER[form] for r in (rope.build(mark.encode()), part[mark])])).decode())
            cols = [column(batch, "doc_id"), pa.array(n, pa.int64()), column(batch, "form"), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = dict(docs.dtypes)["doc_id"]
    return drawn.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """rows (form, output, others) with the column `restored`: the text that was transformed, from form and output alone. An output without its form's sentinels in their order, or a null one, has none."""
    bound_batches(rows.sparkSession)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "output"):
            texts = [_restored(o, f) for o, f in zip(column(batch, "output").to_pylist(), column(batch, "form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "restored"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("restored", StringType())]))


def _restored(output: str | None, form: str | None) -> str | None:
    if output is None or form == "plain":
        return output
    rest, part = rope.build(output.encode()), {}
    marks = ORDER.get(form or "", ())
    for k, mark in enumerate(marks):
        at = rope.find(rest, mark.encode())
        if at < 0 or (k == 0 and at):
            return None
        body, rest = rope.split_chars(rest, at)
        if k:
            part[marks[k - 1]] = body
        _, rest = rope.split_chars(rest, len(mark))
    if not marks:
        return None
    part[marks[-1]] = rest
    return rope.text_of(rope.join(part[PREFIX], part[MIDDLE], part[SUFFIX])).decode()


#: The query in DuckDB's SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS low, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS high,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:low], ''), '') AS p, coalesce(array_to_string(u[low + 1:high], ''), '') AS m, coalesce(array_to_string(u[high + 1:], ''), '') AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM g
"""

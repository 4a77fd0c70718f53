"""Language identification by compression with per-language zstandard raw-content dictionaries."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import unused

#: Labelled rows a language gives to its dictionary, at most, and their characters: whole texts, drawn by hash, as many as fit.
#: These bound the fitting alone.
SAMPLE_ROWS = 400
SAMPLE_CHARS = 400_000
#: Texts are encoded in blocks of this many bytes, so that a long text's own repetitions don't outweigh the dictionary.
BLOCK = 4096
#: Least (second size - least size) / least size. Below it the text is rejected.
MARGIN = 0.004

_CACHE: dict = {}


def _parameters() -> zstandard.ZstdCompressionParameters:
    """Greedy parsing with matches of four bytes upwards: finds common short words, which the fast levels' five miss."""
    return zstandard.ZstdCompressionParameters(
        window_log=20, chain_log=20, hash_log=18, search_log=4, min_match=4, target_length=0, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False
    )


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, bytes]:
    """Dictionaries by language from at most `sample_rows` labelled rows of each, those of least hash of id and text, whole, as
    long as they have `sample_chars` characters together; a longer text is never drawn.

    Rows without text or label don't count; null ids count like others; rows repeated with id and text count once, under a
    repeated id each different text counts. No labelled row: no dictionary, and every text is then rejected.
    """
    labelled = docs.select(F.col(lang_col).cast("string").alias("g"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("t")).where("g is not null and t is not null and t <> ''")
    sized = labelled.select("g", "h", F.char_length("t").cast("bigint").alias("n")).where(F.col("n") <= sample_chars).groupBy("g", "h").agg(F.max("n").alias("n"))
    order = Window.partitionBy("g").orderBy("h")
    first = sized.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_rows)
    chosen = first.withColumn("sum", F.sum("n").over(order)).where(F.col("sum") <= sample_chars).select("g", "h")
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), "g string, h bigint")  # sample_rows a language, at most
    found = labelled.join(F.broadcast(chosen), ["g", "h"]).groupBy("g", "h").agg(F.min("t").alias("t"))
    pieces: dict[str, list[str]] = {}
    for g, _, t in sorted(found.collect()):
        pieces.setdefault(g, []).append(t)
    return {g: "\n".join(dict.fromkeys(x.lower() for x in ts)).encode("utf-8", "replace") for g, ts in sorted(pieces.items())}


def encoders(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    key = tuple(dictionaries.items())
    if key not in _CACHE:
        _CACHE.clear()
        out = []
        for lang, content in dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=_parameters())
            out.append((lang, zstandard.ZstdCompressor(compression_params=_parameters(), dict_data=d)))
        _CACHE[key] = out
    return _CACHE[key]


def sizes(text: str, by_lang: list[tuple[str, zstandard.ZstdCompressor]]) -> list[tuple[int, str]]:
    """Encoded size of the whole lower-cased text by language, least first; equal sizes in order of language."""
    data = text.lower().encode("utf-8", "replace")
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    return sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in by_lang)


def verdict(text: str | None, by_lang: list[tuple[str, zstandard.ZstdCompressor]], margin: float = MARGIN) -> tuple[str | None, int | None, float, bool]:
    """(language, size, margin, accepted). One language alone has margin 1."""
    if not text or not by_lang:
        return None, None, 0.0, False
    ranked = sizes(text, by_lang)
    gap = (ranked[1][0] - ranked[0][0]) / ranked[0][0] if len(ranked) > 1 else 1.0
    return ranked[0][1], ranked[0][0], gap, gap >= margin


KIND = pa.struct([("lang", pa.string()), ("size", pa.int64()), ("margin", pa.float64()), ("accepted", pa.bool_())])


def detect(text: Column, dictionaries: dict[str, bytes], margin: float = MARGIN) -> Column:
    """struct(lang, size, margin, accepted) of a text. Null and empty texts are rejected with no language; a tie has margin 0."""

    @F.arrow_udf("struct<lang:string,size:bigint,margin:double,accepted:boolean>")
    def run(texts: pa.Array) -> pa.Array:
        by_lang = encoders(dictionaries)
        out = [verdict(t.as_py(), by_lang, margin) for t in texts]
        return pa.StructArray.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*out), KIND)], fields=list(KIND)) if out else pa.array([], KIND)

    return run.asNondeterministic()(text)  # so that the optimiser never evaluates it twice


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each input row: doc_id, lang (null where rejected), nearest, size, margin, accepted.

    Null or empty text: no language, rejected. Sizes that tie: nearest is the first language by name, margin 0, rejected.
    Repeated rows are judged one by one; an empty table gives an empty result; further columns don't matter.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), detect(F.col(text_col), dictionaries, margin).alias("d"))
    return d.select("doc_id", F.when(F.col("d.accepted"), F.col("d.lang")).alias("lang"), F.col("d.lang").alias("nearest"), F.col("d.size").alias("size"), F.round("d.margin", 6).alias("margin"), F.col("d.accepted").alias("accepted"))


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The accepted rows with all their columns; `lang` becomes the language found. Null, empty and undecided texts go."""
    name = unused(docs, "lang_found")
    found = docs.withColumn(name, detect(F.col("text"), dictionaries, margin))
    return found.where(F.col(name)["accepted"]).withColumn("lang", F.col(name)["lang"]).select(*docs.columns)

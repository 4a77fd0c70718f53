"""Normalisers, URL rules, list and text functions as Column expressions. Nulls give null unless said otherwise."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.domains import TOP_LEVEL


def trim_control(c: Column) -> Column:
    """Without characters up to U+0020 at both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def prepare_query(c: Column) -> Column:
    return trim_control(F.lower(c))


def prepare_url(c: Column) -> Column:
    """Trimmed, without a leading http://, then https://, then www., each once at most and in this order."""
    out = trim_control(c)
    for prefix in ("http://", "https://", r"www\."):
        out = F.regexp_replace(out, f"^{prefix}", "")
    return out


def is_valid_url(c: Column, known: frozenset[str] = TOP_LEVEL) -> Column:
    """Whether the host's part after its last dot is a known top-level domain; a port makes it invalid. Null is invalid."""
    host = F.split_part(prepare_url(c), F.lit("/"), F.lit(1))
    return F.coalesce(F.regexp_extract(host, r"\.([^.]*)$", 1).isin(*sorted(known)), F.lit(False))


def split_links(c: Column, delimiter: str = ",", known: frozenset[str] = TOP_LEVEL) -> Column:
    """List of URLs of a delimited string. A piece that is no URL belongs to the URL before it, as URLs may hold the delimiter;
    such pieces before the first URL are dropped. Null gives an empty list."""

    def fold(acc: Column, piece: Column) -> Column:
        glued = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(delimiter), piece)))
        return F.when(is_valid_url(piece, known), F.concat(acc, F.array(piece))).when(F.size(acc) == 0, acc).otherwise(glued)

    return F.aggregate(F.split(F.coalesce(c, F.lit("")), f"\\Q{delimiter}\\E"), F.array().cast("array<string>"), fold)


def parse_links(c: Column) -> Column:
    return F.transform(split_links(c), prepare_url)


def list_to_string(c: Column, delimiter: str) -> Column:
    return F.array_join(c, delimiter)


def string_to_list(c: Column, delimiter: str) -> Column:
    """Non-empty pieces."""
    return F.filter(F.split(c, f"\\Q{delimiter}\\E"), lambda x: x != "")


def domain(c: Column) -> Column:
    """Host of an absolute URL without a leading www.; '' if there is none."""
    return F.coalesce(F.regexp_replace(F.try_parse_url(trim_control(c), F.lit("HOST")), r"^www\.", ""), F.lit(""))


def overlap_similarity(a: Column, b: Column) -> Column:
    """Number of common distinct elements / (size of a * size of b); null if either is empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(a) * F.size(b))


def link_similarity(shown_a: Column, clicked_a: Column, shown_b: Column, clicked_b: Column, shown_weight: float = 1.0, clicked_weight: float = 5.0) -> Column:
    """Weighted overlap of shown and of clicked links; 0 if any of the four lists is empty."""
    return F.coalesce(shown_weight * overlap_similarity(shown_a, shown_b) + clicked_weight * overlap_similarity(clicked_a, clicked_b), F.lit(0.0))


def words(c: Column, unicode: bool = True) -> Column:
    """Words of a text. unicode: letters, digits and underscore of any script, no empty words. Otherwise only ASCII ones count
    as word characters, and a text that starts with another character has an empty first word, unless it has no other."""
    if unicode:
        return F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    parts = F.split(c, r"\W+")
    last = F.array_max(F.filter(F.transform(parts, lambda x, i: F.when(x != "", i + 1)), lambda i: i.isNotNull()))
    return F.slice(parts, F.lit(1), F.coalesce(last, F.lit(0)))


def text_similarity(a: Column, b: Column, unicode: bool = True) -> Column:
    return F.coalesce(overlap_similarity(words(a, unicode), words(b, unicode)), F.lit(0.0))


def char_ngrams_tail(c: Column, n: int) -> Column:
    """A gram at every position of the squeezed, trimmed text; those at the end are shorter."""
    t = F.trim(F.regexp_replace(c, " +", " "))
    return F.regexp_extract_all(t, F.lit(f"(?s)(?![\\x{{DC00}}-\\x{{DFFF}}])(?=(.{{1,{n}}}))"), F.lit(1))


def char_ngrams(c: Column, n: int, include_last: bool = False) -> Column:
    """Grams of the lower-cased text without spaces; the last full gram only with include_last.

    One pass of a look-ahead over the text: taking substrings by place would walk from its start for every gram.
    """
    t = F.lower(F.replace(c, F.lit(" "), F.lit("")))
    grams = F.regexp_extract_all(t, F.lit(f"(?s)(?![\\x{{DC00}}-\\x{{DFFF}}])(?=(.{{{n}}}))"), F.lit(1))
    return grams if include_last else F.slice(grams, F.lit(1), F.greatest(F.size(grams) - 1, F.lit(0)))


def clean_text(c: Column) -> Column:
    """Lower case; entities of space and dash, and all but letters and digits, become spaces."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "&nbsp;|&mdash;", " "), r"[^\p{L}\p{N}]", " ")


def split_letters(c: Column) -> Column:
    """A word cut where letters and other characters meet."""
    return F.filter(F.split(c, r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})"), lambda x: x != "")


def tokenize(c: Column, stop_words: list[str] | None = None, boundaries: bool = False) -> Column:
    """Words of the cleaned text, cut at letter boundaries if wanted, without stop words."""
    # one pass: a pattern that is looked for in each word anew would also be compiled anew
    cut = r"(?:&nbsp;|&mdash;|[^\p{L}\p{N}])+" + (r"|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})" if boundaries else "")
    parts = F.filter(F.split(F.lower(c), cut), lambda x: x != "")
    return without(parts, stop_words) if stop_words else parts


def without(tokens: Column, stop_words: list[str]) -> Column:
    return F.filter(tokens, lambda x: ~x.isin(*stop_words))


def space_split(c: Column) -> Column:
    """Pieces between single spaces, empty ones too."""
    return F.split(c, " ")


def lemmatise(c: Column, analyser: Callable[[str], str] | None = None) -> Column:
    """Each token's lemma by an analyser that workers run on Arrow batches; without one, the tokens themselves."""
    if analyser is None:
        return c

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        seen: dict[str, str] = {}
        return batch.map(lambda xs: None if xs is None else [seen.setdefault(x, analyser(x)) if x not in seen else seen[x] for x in xs])

    return run(c)


def bound(make: Callable[..., Column], *columns: Column) -> Column:
    """make(*columns), each column evaluated once a row however often, and inside whatever lambda, make uses it."""
    return F.element_at(F.transform(F.array(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])), lambda x: make(*[x[f"c{i}"] for i in range(len(columns))])), 1)


def word_ngrams(tokens: Column, n: int, kind: str = "plain", separator: str = " ") -> Column:
    """plain: runs of n tokens; reversed: the same backwards; gap: pairs of tokens that stand n apart. Joined by a separator."""

    def make(t: Column) -> Column:
        places = [0, n] if kind == "gap" else [*range(n)][:: -1 if kind == "reversed" else 1]
        count = F.greatest(F.size(t) - max(places), F.lit(0))
        moved = [F.slice(t, p + 1, count) for p in places]  # the same length, each a place on
        out = moved[0]
        for other in moved[1:]:
            out = F.zip_with(out, other, lambda a, b: F.concat(a, F.lit(separator), b))
        return out

    return bound(make, tokens)


def phrase_count(pattern: Column, tokens: Column) -> Column:
    """How often phrase_positions finds the pattern, by strings: one pass over the text whatever the pattern's length. Tokens
    must not hold U+0001."""
    mark = lambda c: F.concat(F.lit("\x01"), F.array_join(c, "\x01\x01"), F.lit("\x01"))

    def make(p: Column, t: Column) -> Column:
        gone = F.octet_length(t) - F.octet_length(F.replace(t, p, F.lit("")))
        return (gone / F.octet_length(p)).cast("int")

    return F.when(F.size(pattern) > 0, bound(make, mark(pattern), mark(tokens))).when(pattern.isNotNull() & tokens.isNotNull(), 0)


def phrase_positions(pattern: Column, tokens: Column) -> Column:
    """0-based positions of the pattern in the tokens, found from the left without overlap. An empty pattern is found nowhere."""
    return bound(_phrase_positions, pattern, tokens)


def _phrase_positions(pattern: Column, tokens: Column) -> Column:
    n = F.size(pattern)
    starts = F.when((n > 0) & (F.size(tokens) >= n), F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    hits = F.filter(starts, lambda i: F.slice(tokens, i + 1, n) == pattern)
    free = lambda acc, i: (F.size(acc) == 0) | (i >= F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)
    return F.aggregate(hits, F.array().cast("array<int>"), lambda acc, i: F.when(free(acc, i), F.concat(acc, F.array(i))).otherwise(acc))


def binarise(c: Column) -> Column:
    return F.when(c > 0, 1.0).otherwise(0.0)


def positive_or_one(c: Column) -> Column:
    return F.when(c > 0, c).otherwise(1.0)


#: Values that are Python objects at a time; bounds a worker's memory, never what is read.
RUN = 64


def in_runs(values: pa.Array, change: Callable, kind: pa.DataType) -> pa.Array:
    """change(value) of each, few of them as Python objects at once: a whole batch of pages would take several times its bytes."""
    out = [pa.array([change(x) for x in values.slice(i, RUN).to_pylist()], kind) for i in range(0, len(values), RUN)]
    done = pa.concat_arrays(out) if out else pa.array([], kind)
    del out
    pa.default_memory_pool().release_unused()
    return done


@F.arrow_udf(T.StringType())
def _inflate(payload: pa.Array) -> pa.Array:
    def one(data: bytes | None) -> str:
        try:
            return zlib.decompress(data).decode("utf-8", "replace") if data is not None else ""
        except zlib.error:
            return ""

    return in_runs(payload, one, pa.string())


def inflate(c: Column) -> Column:
    """Text of a base64 string of zlib data; '' for bad or missing data."""
    return _inflate(F.try_to_binary(c, F.lit("base64")))


#: A link is what starts, at the text's start or after a character that belongs to no word, with a scheme or with `www.`, goes on
#: with a label and a dot, and runs as far as characters of URLs go. The same in Java's and RE2's syntax; group 1 is the link.
URL_PATTERN = r"(?i)(?:^|\W)((?:https?://|ftps?://|www\.)[\w-]+\.[\w!#$%&'()*+,./:;=?@\[\]{}~-]*)"


def extract_urls(html: Column) -> Column:
    """Links of a page in order, with scheme or `www.`, repeats kept; punctuation at their end belongs to them."""
    return F.regexp_extract_all(html, F.lit(URL_PATTERN), F.lit(1))

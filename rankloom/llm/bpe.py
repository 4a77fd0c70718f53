"""Byte-level BPE by DuckDB recursive queries inside each partition.

Token-position rows of all words new to the worker join the merge table; every round contracts each word's pair of least
rank, leftmost first, until no pair is left. Decoding joins the vocabulary and aggregates its bytes in order of position.

A long word (a text without spaces, a run of letters) is contracted in blocks of BLOCK bytes, whose seams are then put right:
the tokens on both sides of a seam are contracted together, and stand once the outermost of them come out as they were. For
tokens of which every two neighbours are the encoding of their own bytes are the encoding of the whole, so the result is that
of contracting the whole word, at a cost in proportion to its length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import slices

#: Tokenizer file with vocabulary and merges; read, never copied or trained.
MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARKS = frozenset(".,;:!?)")
#: Words whose tokens a worker remembers, and stretches of text between spaces, at most; when full, it keeps those in use.
REMEMBERED = 350_000
#: Words of more bytes than this are contracted in blocks of as many.
BLOCK = 64
#: Rows that one query makes, about and at most (a word of n bytes makes n * n / 2 or fewer), tokens of one decoding query, and
#: bytes of text looked at together: they bound memory, never what is read.
ROWS_AT_ONCE = 2_500_000
TOKENS_AT_ONCE = 1_000_000
BATCH_BYTES = 4 << 20

_CACHE: dict[str, Codec] = {}

# Rows are (k, tok, nk, nt): word and position in one key, the token there, the key and token that follow in the word. A round
# joins them to the merge table, takes each word's least (rank, position), and contracts there; words without a pair drop out,
# so the rows of a word's last round are its tokens.
_ENCODE = """
with recursive r(k, tok, nk, nt, round) as (
  select k, tok, nk, nt, 0 from fresh
  union all
  select r.k, case when r.k = b.k then b.made else r.tok end, case when r.k = b.k then b.after else r.nk end,
    case when r.k = b.k then b.after_tok when r.nk = b.k then b.made else r.nt end, r.round + 1
  from r join (
    select a.w, a.k, a.q, a.made, x.nk as after, x.nt as after_tok from (
      select w, (w << 32) | (least & 65535) as k, (w << 32) | ((least >> 16) & 65535) as q, m.made from (
        select r.k >> 32 as w, min((m.rank::bigint << 32) | ((r.nk & 65535) << 16) | (r.k & 65535)) as least
        from r join merges m on (r.tok::bigint << 32) | r.nt = m.pair where r.nt >= 0 group by 1
      ) join merges m on m.rank = least >> 32
    ) a join r x on x.k = a.q
  ) b on r.k >> 32 = b.w where r.k <> b.q
)
select k, tok, round from r
"""
# Rows in order are aggregated in order by the one thread that the connection has. What is decoded is compared with its source;
# if they differed, it would go through the slower query, which orders inside the aggregate.
_DECODE = "select doc, string_agg(bytes, '') as hex from (select doc, bytes from tokens join vocabulary using (tok) order by pos) group by doc order by doc"
_DECODE_SLOW = "select doc, string_agg(bytes, '' order by pos) as hex from tokens join vocabulary using (tok) group by doc order by doc"


class Codec:
    def __init__(self, path: str = MODEL):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # the file writes each byte as a printable character
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        ids = model["vocab"]
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        self.first = np.full(256, -1, dtype=np.int32)
        for c, b in byte_of.items():
            self.first[b] = ids[c]
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.findall = regex.compile(PATTERN).findall
        self.stretches = regex.compile(r"\s*\S+|\s+").findall
        self.uneven = regex.compile(r"\s ").search
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB"})
        pieces = {i: "".join(f"{byte_of[c]:02X}" for c in p) for p, i in ids.items() if all(c in byte_of for c in p)}
        self.size = np.zeros(max(ids.values()) + 1, dtype=np.int64)
        for i, p in pieces.items():
            self.size[i] = len(p) // 2
        left, right, made = (np.array([ids[k] for k in part], dtype=np.int64) for part in ([m[0] for m in merges], [m[1] for m in merges], [m[0] + m[1] for m in merges]))
        rank = np.arange(len(merges))
        # a token is made by one merge, which comes after those that make its parts: then ranks never fall while a word contracts
        by = np.full(len(self.size), -1)
        by[made] = rank
        if len(np.unique(made)) < len(made) or (by[left] >= rank).any() or (by[right] >= rank).any():
            raise ValueError(f"{path}: a token has two merges, or one that comes before its parts'")
        self._table("merges", {"pair": left << 32 | right, "rank": rank.astype(np.int32), "made": made.astype(np.int32)})
        self._table("vocabulary", {"tok": np.array(list(pieces), dtype=np.int32), "bytes": pa.array(list(pieces.values()))})

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"create or replace table {name} as select * from incoming")
        self.db.unregister("incoming")

    def _contract(self, raw: list[bytes]) -> Iterator[bytes]:
        """Tokens of each byte string, all of them short, in as many queries as ROWS_AT_ONCE wants; as little-endian int32."""
        rows = np.cumsum([len(b) * len(b) // 2 + 1 for b in raw])
        lo = 0
        while lo < len(raw):
            hi = max(lo + 1, int(np.searchsorted(rows, (rows[lo - 1] if lo else 0) + ROWS_AT_ONCE, side="right")))
            some = raw[lo:hi]
            size = np.array([len(b) for b in some])
            end = np.cumsum(size)
            tok = self.first[np.frombuffer(b"".join(some), np.uint8)]
            key = (np.repeat(np.arange(len(some), dtype=np.int64), size) << 32) + np.arange(len(tok)) - np.repeat(end - size, size)
            after, after_tok = key + 1, np.append(tok[1:], np.int32(-1))
            after[end - 1] = after_tok[end - 1] = -1
            self._table("fresh", {"k": key, "tok": tok, "nk": after, "nt": after_tok})
            out = self.db.execute(_ENCODE).fetchnumpy()
            k, tok, turn = out["k"], out["tok"], out["round"]
            if (turn[1:] < turn[:-1]).any():  # rounds come one after another
                order = np.argsort(turn, kind="stable")
                k, tok, turn = k[order], tok[order], turn[order]
            w = k >> 32
            final = np.zeros(len(some), turn.dtype)
            final[w] = turn  # of a word's rounds the last stands
            at = np.flatnonzero(turn == final[w])
            at = at[np.argsort(k[at])]
            data, ends = tok[at].astype(np.int32).tobytes(), (4 * np.searchsorted(w[at], np.arange(len(some) + 1))).tolist()
            del out, k, tok, turn, w, at
            yield from (data[i:j] for i, j in zip(ends, ends[1:]))
            lo = hi

    def _stitched(self, raw: list[bytes]) -> Iterator[list[int]]:
        """Tokens of each long byte string: of its blocks first, then over every seam."""
        blocks = [[b[i : i + BLOCK] for i in range(0, len(b), BLOCK)] for b in raw]
        met: dict[bytes, list[int]] = {}

        def meet(wanted: list[bytes]) -> None:
            new = [b for b in dict.fromkeys(wanted) if b not in met]
            for b, t in zip(new, self._contract(new)):
                met[b] = np.frombuffer(t, np.int32).tolist()

        def written(tokens: list[int], source: bytes, at: int, back: bool) -> bytes:
            """The bytes of tokens that end (back) or start at a place of the source."""
            n = int(self.size[tokens].sum())
            return source[at - n : at] if back else source[at : at + n]

        meet(list(chain.from_iterable(blocks)))
        coded = [[met[x] for x in own] for own in blocks]
        half = lambda t: len(t) // 2
        seam = lambda b, own, j: written(own[j][len(own[j]) - half(own[j]) :], b, (j + 1) * BLOCK, True) + written(own[j + 1][: half(own[j + 1])], b, (j + 1) * BLOCK, False)
        seams = [[seam(b, own, j) for j in range(len(own) - 1)] for b, own in zip(raw, coded)]
        meet([x for own in seams for x in own if x])
        for b, own, between in zip(raw, coded, seams):
            # a seam whose outermost tokens stay is settled: the halves around it are replaced by its tokens
            parts: list[list[int]] = []
            left = 0  # tokens of the block that belong to the seam before it
            now: list[int] = []
            for j, tokens in enumerate(own):
                h = half(tokens)
                w = met[between[j]] if j < len(between) and between[j] else []
                after = own[j + 1] if j < len(between) else []
                if w and h and half(after) and w[0] == tokens[len(tokens) - h] and w[-1] == after[half(after) - 1]:
                    now += tokens[left : len(tokens) - h] + w
                    left = half(after)
                else:
                    now += tokens[left:]
                    parts.append(now)
                    now, left = [], 0
            # the others from left to right, some tokens at a time, until they fall in with what follows
            out, place = parts[0], int(self.size[parts[0]].sum())
            for part in parts[1:]:
                i, back = 0, 4
                while i < len(part):
                    a, c = out[-back:], part[i : i + 8]
                    x = written(a, b, place, True) + written(c, b, place, False)
                    meet([x])
                    w = met[x]
                    if len(a) < len(out) and w[0] != a[0]:
                        back *= 2
                        continue
                    del out[len(out) - len(a) :]
                    out += w
                    i, back = i + len(c), 4
                    place += int(self.size[c].sum())
                    if w[-1] == c[-1]:
                        out += part[i:]
                        place += int(self.size[part[i:]].sum())
                        break
            yield out

    def contract(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its token ids as little-endian int32 bytes."""
        raw = [x.encode("utf-8", "replace") for x in words]
        short, long = [i for i, b in enumerate(raw) if len(b) <= BLOCK], [i for i, b in enumerate(raw) if len(b) > BLOCK]
        for i, tokens in zip(short, self._contract([raw[i] for i in short])):
            yield words[i], tokens
        for i, tokens in zip(long, self._stitched([raw[i] for i in long])):
            yield words[i], np.array(tokens, np.int32).tobytes()

    def split(self, text: str) -> list[str]:
        """Names of the text's stretches, each white space with the rest up to the next: no word runs over their ends.

        A stretch of one space and more has the more as its name, any other a space and itself.
        """
        if not self.uneven(text):
            first, *rest = text.split(" ")
            return [" " + first, *rest] if first else rest
        return [x[1:] if x[0] == " " and " " not in x[1:] else " " + x for x in self.stretches(text)]

    def _words(self, name: str) -> list[str]:
        """The pattern's matches in a stretch; the commonest kinds, a word and one with a mark after it, without the pattern."""
        if name.isascii():
            if name.isalpha():
                return [" " + name]
            if name[-1:] in MARKS and name[:-1].isalpha():
                return [" " + name[:-1], name[-1]]
        return self.findall(name[1:] if name[:1] == " " else " " + name)

    def learn(self, names: list[str]) -> None:
        """Encode stretches and remember their tokens, and those of their words."""
        split = [self._words(x) for x in names]
        used = set(chain.from_iterable(split))
        if len(self.words) >= REMEMBERED:
            self.words = {x: self.words[x] for x in used.intersection(self.words)}
        self.words.update(self.contract(sorted(used.difference(self.words))))
        of = self.words
        for name, words in zip(names, split):
            self.known[name] = of[words[0]] if len(words) == 1 else b"".join([of[x] for x in words])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each whole text as little-endian int32 bytes; specials' strings are ordinary text."""
        split = [self.split(t) for t in texts]
        used = set().union(*split) if split else set()
        if len(self.known) >= REMEMBERED:
            self.known = {x: self.known[x] for x in used.intersection(self.known)}
        fresh = used.difference(self.known)
        if fresh:
            self.learn(list(fresh))
        known = self.known.__getitem__
        return [b"".join(map(known, names)) for names in split]

    def decode(self, tokens: np.ndarray, docs: np.ndarray, number: int, query: str = _DECODE_SLOW) -> list[bytes]:
        """Bytes of each of `number` texts from rows (text's index, token) in order."""
        texts = [b""] * number
        docs = docs.astype(np.int32)
        for i in range(0, len(tokens), TOKENS_AT_ONCE):
            tok, doc = tokens[i : i + TOKENS_AT_ONCE], docs[i : i + TOKENS_AT_ONCE]
            self.db.register("tokens", pa.table({"doc": doc, "pos": np.arange(len(tok), dtype=np.int32), "tok": tok}))
            out = self.db.execute(query).fetchnumpy()
            self.db.unregister("tokens")
            for d, h in zip(out["doc"].tolist(), out["hex"]):
                texts[d] += bytes.fromhex(h)
        return texts


def codec(path: str = MODEL) -> Codec:
    if path not in _CACHE:
        _CACHE[path] = Codec(path)
    return _CACHE[path]


def encode(text: Column, path: str = MODEL) -> Column:
    """struct(tokens array<int>, crc): token ids, and the CRC-32 of the bytes that decoding them gives."""

    @F.arrow_udf("struct<tokens:array<int>,crc:bigint>")
    def run(texts: pa.Array) -> pa.Array:
        c = codec(path)
        ids: list[bytes] = []
        crc: list[int] = []
        for lo, hi in slices(texts, BATCH_BYTES):
            part = [t.as_py() or "" for t in texts[lo:hi]]
            coded = c.encode(part)
            tokens = np.frombuffer(b"".join(coded), np.int32)
            owner = np.repeat(np.arange(len(part)), [len(b) // 4 for b in coded])
            back = c.decode(tokens, owner, len(part), _DECODE)
            if any(b != t.encode("utf-8", "replace") for b, t in zip(back, part)):
                back = c.decode(tokens, owner, len(part))
            ids += coded
            crc += map(zlib.crc32, back)
        offsets = np.cumsum([0, *(len(b) // 4 for b in ids)]).astype(np.int32)
        gone = texts.is_null()
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)), mask=gone)
        return pa.StructArray.from_arrays([lists, pa.array(crc, pa.int64(), mask=np.asarray(gone))], ["tokens", "crc"])

    return run.asNondeterministic()(text)


def decode(tokens: Column, path: str = MODEL) -> Column:
    """The text of token ids; null for null, '' for none. Bytes that aren't UTF-8 become U+FFFD."""

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        c = codec(path)
        size = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], dtype=np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        out = c.decode(flat, np.repeat(np.arange(len(lists)), size), len(lists))
        return pa.array([b.decode("utf-8", "replace") for b in out], pa.string(), mask=np.asarray(lists.is_null()))

    return run.asNondeterministic()(tokens)


def tokenize(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, tokens, lossless of each row; lossless: decoding the tokens gives the text's bytes (by CRC-32).

    Null texts give null in all three, empty ones no tokens. Very long texts and words are encoded whole. Repeated rows are
    encoded one by one; an empty table gives an empty result; further columns don't matter.
    """
    d = docs.select("doc_id", encode(F.col("text"), path).alias("e"), F.crc32(F.encode("text", "utf-8")).alias("c"))
    return d.select("doc_id", F.when(F.col("e.tokens").isNotNull(), F.size("e.tokens")).alias("n_tokens"), "e.tokens", (F.col("e.crc") == F.col("c")).alias("lossless"))

"""URL filters: allow and block entries in a trie over reversed host labels and path segments; the longest match decides."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries that may be broadcast as a trie, and their characters; more are matched by a join instead, with the same answers.
BROADCAST_ENTRIES = 200_000
BROADCAST_CHARS = 16 << 20
#: Parts into which each key is split in that join, as one host or path may hold much of all urls.
SALT = 16

_URL = re.compile(r"\A\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)([^?#]*)")


#: Keys of a node that no label or segment equals; numbers, so that they stay the same in every process.
_FOUND, _PATHS = 0, 1


def parts(url: str | None) -> tuple[list[str], list[str]] | None:
    """(reversed host labels, path segments). The host in lower case without user, port and final dots, empty labels kept; empty
    segments are dropped; query and fragment don't count. None if there is no host but dots."""
    m = _URL.match(url or "")
    if not m:
        return None
    host = re.sub(r":\d*\Z", "", m[1].rpartition("@")[2]).lower().rstrip(".")
    return (host.split(".")[::-1], [s for s in m[2].split("/") if s]) if host else None


def entry_parts(entry: str) -> tuple[list[str], list[str]] | None:
    return parts(entry if "//" in entry else f"//{entry}")


def build(rules: list[tuple[str, str]]) -> dict:
    """Nested nodes {label: node}, under _PATHS a node's path trie {segment: node}, under _FOUND (entry, action). Labels may be
    empty; these two keys are no strings. For one key with both actions block stands."""
    root: dict = {}
    for entry, action in rules:
        p = entry_parts(entry)
        if p is None or action not in ("allow", "block"):
            continue
        node = root
        for label in p[0]:
            node = node.setdefault(label, {})
        for k, segment in enumerate(p[1]):
            node = node.setdefault(_PATHS, {}) if k == 0 else node
            node = node.setdefault(segment, {})
        key = ".".join(p[0][::-1]) + "".join("/" + s for s in p[1])
        if node.get(_FOUND, ("", ""))[1] != "block":
            node[_FOUND] = (key, action)
    return root


def match(trie: dict, url: str | None) -> tuple[str, str] | None:
    """(entry, action) of the longest match: most host labels first, then most path segments."""
    p = parts(url)
    node, found = trie, None
    for label in p[0] if p else ():
        node = node.get(label)
        if node is None:
            break
        found = node.get(_FOUND, found)
        deep = node.get(_PATHS)
        for segment in p[1] if deep is not None else ():
            deep = deep.get(segment)
            if deep is None:
                break
            found = deep.get(_FOUND, found)
    return found


def _by_trie(url: Column, trie: dict, df: DataFrame) -> Column:
    sent = df.sparkSession.sparkContext.broadcast(trie)

    @F.arrow_udf("struct<entry:string,action:string>")
    def run(urls: pa.Array) -> pa.Array:
        found = [match(sent.value, u.as_py()) or (None, None) for u in urls]
        return pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], ["entry", "action"])

    return run.asNondeterministic()(url)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame = (), default: str = "allow", limit: int = BROADCAST_ENTRIES) -> DataFrame:
    """page_id, url, entry, decision of each row: the longest matching entry and its action, or null and the default.

    Most host labels count first, then most path segments; of equal entries block stands. Null, empty and host-less urls (dots
    are no host) match nothing and are blocked; a host may have empty labels (`a..b`). Repeated rows are judged one by one; an
    empty table gives an empty result; without rules all take the default; further columns don't matter.

    rules: a list, or a DataFrame (entry, action) of any size: beyond `limit` rows or BROADCAST_CHARS characters they aren't
    broadcast as a trie, but joined with the (host suffix, path prefix) of the urls. Both ways give the same rows.
    """
    if not isinstance(rules, DataFrame):
        rules = list(rules)
        if len(rules) > limit or sum(len(e or "") for e, _ in rules) > BROADCAST_CHARS:
            return _by_join(pages, pages.sparkSession.createDataFrame(rules, "entry string, action string"), default)
    else:
        few = rules.select("entry", "action").where("entry is not null and action in ('allow', 'block')")
        n, chars = few.agg(F.count("*"), F.coalesce(F.sum(F.char_length("entry")), F.lit(0))).first()
        if n > limit or chars > BROADCAST_CHARS:
            return _by_join(pages, few, default)
        rules = [tuple(r) for r in few.collect()]  # limit rows, at most
    m = pages.select("page_id", "url", _by_trie(F.col("url"), build([r for r in rules if r[0] is not None]), pages).alias("m"))
    return m.select("page_id", "url", F.col("m.entry").alias("entry"), _decision(F.col("m.action"), F.col("url"), default))


def _decision(action: Column, url: Column, default: str) -> Column:
    return F.coalesce(action, F.when(_host(url) != "", F.lit(default)), F.lit("block")).alias("decision")


def _authority(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)([^?#]*)", group), F.lit(""))


def _host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(_authority(url, 1), r"^.*@", ""), r":\d*$", "")), r"\.+$", "")


def _labels(url: Column) -> Column:
    return F.split(_host(url), r"\.")


def _segments(url: Column) -> Column:
    return F.filter(F.split(_authority(url, 2), "/"), lambda s: s != "")


def _keys(url: Column, most_labels: int, most_segments: int) -> Column:
    """array<struct<labels, segments, key>>: each host suffix with each path prefix, as far as any rule goes."""
    labels = F.slice(F.reverse(_labels(url)), 1, most_labels)
    segments = F.slice(_segments(url), 1, most_segments) if most_segments else F.array().cast("array<string>")
    join = lambda h, p: F.concat_ws("", F.array_join(F.reverse(F.slice(labels, F.lit(1), h)), "."), F.transform(F.slice(segments, F.lit(1), p), lambda s: F.concat(F.lit("/"), s)))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda h: F.transform(F.sequence(F.lit(0), F.size(segments)), lambda p: F.struct(h.alias("labels"), p.alias("segments"), join(h, p).alias("key")))))


def _by_join(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The longest match by a join on keys no longer than the longest rule's; keys are salted, as one may be in most urls."""
    url = F.when(F.col("entry").contains("//"), F.col("entry")).otherwise(F.concat(F.lit("//"), F.col("entry")))
    whole = F.concat_ws("", F.array_join(_labels(url), "."), F.transform(_segments(url), lambda s: F.concat(F.lit("/"), s)))
    good = rules.where("action in ('allow', 'block')").where(_host(url) != "").select(whole.alias("key"), "action", F.size(_labels(url)).alias("l"), F.size(_segments(url)).alias("s"))
    last = good.groupBy("key").agg(F.max("action").alias("action"))
    most_labels, most_segments = good.agg(F.coalesce(F.max("l"), F.lit(1)), F.coalesce(F.max("s"), F.lit(0))).first()
    salted = last.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    distinct = pages.select("url").distinct()
    tried = distinct.where(_host(F.col("url")) != "").select("url", F.explode(_keys(F.col("url"), most_labels, most_segments)).alias("k")).select("url", "k.*", F.pmod(F.hash("url"), F.lit(SALT)).alias("salt"))
    best = tried.join(salted, ["key", "salt"]).groupBy("url").agg(F.max_by(F.struct("key", "action"), F.struct("labels", "segments")).alias("m"))
    out = pages.select("page_id", F.col("url").alias("u")).join(best, F.col("u").eqNullSafe(best["url"]), "left")
    return out.select("page_id", F.col("u").alias("url"), F.col("m.key").alias("entry"), _decision(F.col("m.action"), F.col("u"), default))


def sql(rules: list[tuple[str, str]]) -> str:
    """DuckDB SQL for the rows of filter_urls(pages, rules)."""
    return r"""
with rules(entry, action) as (values %s),
r as (select split_part(entry, '/', 1) as h, case when contains(entry, '/') then substr(entry, strpos(entry, '/')) else '' end as p, entry, action from rules),
u as (
  select page_id, url,
    regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)', 1), '^.*@', ''), ':\d*$', '')), '\.+$', '') as host,
    rtrim(regexp_replace(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)', 2), '/+', '/', 'g'), '/') || '/' as path
  from pages
),
d as (select distinct url, host, path from u),
m as (
  select d.url, arg_max(entry, {'a': len(string_split(h, '.')), 'b': len(string_split(p, '/')), 'c': action}) as entry,
    arg_max(action, {'a': len(string_split(h, '.')), 'b': len(string_split(p, '/')), 'c': action}) as action
  from d join r on ('.' || host) like ('%%.' || h) and starts_with(path, p || case when p = '' then '' else '/' end) and host <> '' group by d.url
)
select page_id, u.url, entry, coalesce(action, case when host <> '' then 'allow' end, 'block') as decision from u left join m on u.url = m.url
""" % ", ".join(f"('{e}', '{a}')" for e, a in rules)

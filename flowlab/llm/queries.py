"""Registered queries of the corpus operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm.ann import nearest_vectors
from flowlab.llm.conversation_trie import conversation_trie
from flowlab.llm.decontaminate import scan_benchmark
from flowlab.llm.language import fit, identify
from flowlab.llm.licenses import FILE, HEADER, STOP, TEMPLATES, WORD, Weights, scan_licenses
from flowlab.llm.lexical_search import search
from flowlab.llm.lm_score import score_texts
from flowlab.llm.lz_fingerprint import fingerprint_texts
from flowlab.llm.near_dedup import near_duplicates
from flowlab.llm.packing import pack_sequences
from flowlab.llm.token_counts import count_tokens
from flowlab.llm.url_filter import judge_urls
from flowlab.llm.warc import assemble, read_warc, with_origin, write_warc
from flowlab.scratch import materialize, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[make.__name__] = make
    return make


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register
def op1_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in windows of 2048 tokens."""
    return pack_sequences(table(spark, folder, "documents"))


@register
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every line of all documents."""
    return count_tokens(table(spark, folder, "documents"))


_PATH = "concat(coalesce(source, '-'), '/', coalesce(lang, '-'), '/', coalesce(cast(doc_id as {}), '-'))"


@register
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of all documents, as files below a directory for each source and language."""
    docs = table(spark, folder, "documents")
    return scan_licenses(docs.withColumn("path", F.expr(_PATH.format("string"))))


_WEIGHTS = Weights(TEMPLATES)
_IDF_ROWS = ", ".join(f"('{w}', {x!r}::double)" for w, x in _WEIGHTS.idf.items())
_HEAVY_ROWS = ", ".join(f"('{w}', {k}, '{n}', {x!r}::double)" for w, k, n, x in _WEIGHTS.rows)
_STOP_LIST = ", ".join(f"'{w}'" for w in sorted(STOP))


def _best_license(name: str, units: str, keys: str, least: float) -> str:
    return f"""
{name}_terms as (
  select {keys}, word, count(*) as times from (select {keys}, unnest(regexp_extract_all(lower(value), '{WORD}')) as word from {units})
  where word not in ({_STOP_LIST}) group by {keys}, word),
{name}_weighed as (select {keys}, t.word, times * coalesce(idf, {_WEIGHTS.other!r}::double) as x from {name}_terms t left join idf on t.word = idf.word),
{name}_sizes as (select {keys}, sqrt(sum(x * x)) as size from {name}_weighed group by {keys}),
{name}_dots as (
  select {keys}, template, license, sum(x * weight) as dot from {name}_weighed w join heavy h on w.word = h.word
  group by {keys}, template, license),
{name}_all as (
  select {keys}, license, round(dot / size, 6) as score from {name}_dots join {name}_sizes using ({keys})),
{name} as (
  select {keys}, license, score from (select *, row_number() over (partition by {keys} order by score desc, license) as k
    from {name}_all where score >= {least}) where k = 1)"""


ORACLES["op3_license_scan"] = f"""
with idf as (select * from (values {_IDF_ROWS}) as v(word, idf)),
heavy as (select * from (values {_HEAVY_ROWS}) as v(word, template, license, weight)),
d as (select row_number() over () as r, {_PATH.format('varchar')} as path, text as value from documents),
lines as (select r, generate_subscripts(split(value, chr(10)), 1) as line, unnest(split(value, chr(10))) as value from d),
{_best_license('found', 'lines', 'r, line', HEADER)},
{_best_license('whole', 'd', 'r', FILE)},
header as (select r, license, score from (select *, row_number() over (partition by r order by score desc, license) as k from found) where k = 1),
own as (
  select d.r, path, regexp_replace(path, '/[^/]*$', '') as dir, coalesce(w.license, h.license) as license, coalesce(w.score, h.score) as score,
    case when w.r is not null then 'file' when h.r is not null then 'header' end as origin
  from d left join whole w on d.r = w.r left join header h on d.r = h.r),
held as (
  select dir, license from (select dir, license, row_number() over (partition by dir order by count(*) desc, license) as k
    from own where origin = 'file' group by dir, license) where k = 1),
near as (
  select dirs.dir, held.dir as from_dir, held.license,
    row_number() over (partition by dirs.dir order by length(held.dir) desc) as k
  from (select distinct dir from own) dirs join held
    on dirs.dir = held.dir or starts_with(dirs.dir, concat(held.dir, '/')) or held.dir = '')
select path, coalesce(own.license, near.license) as license, score,
  coalesce(origin, case when near.license is not null then 'inherited' else 'none' end) as origin,
  case when origin is null then from_dir end as from_dir
from own left join near on own.dir = near.dir and near.k = 1
"""


def fold(key: str, parts: int) -> Column:
    """Remainder of the crc32 of an id as text; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


@register
def op4_score_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents by a suffix tree learned from four of five folds."""
    return score_texts(table(spark, folder, "documents"), fold("doc_id", 5) == 1)


@register
def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of all documents at a Jaccard similarity of 0.85 on 5-word shingles."""
    return near_duplicates(table(spark, folder, "documents"), 85, 100).select(
        "doc_id", "n_shingles", "component_id", "kept")


ORACLES["op5_near_duplicates"] = r"""
with recursive d as (
  select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from documents),
s as materialized (
  select distinct r, array_to_string(ws[i:i + 4], ' ') as g from (
    select r, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from d where len(ws) > 0)),
n as materialized (select r, count(*) as n from s group by r),
c as (select a.r as a, b.r as b, count(*) as common from s a join s b on a.g = b.g and a.r < b.r group by 1, 2),
links as materialized (
  select a, b from c join n x on a = x.r join n y on b = y.r where 100 * common >= 85 * (x.n + y.n - common)),
ways as materialized (select a, b from links union all select b, a from links),
reach as (select r as a, r as b from d union select reach.a, ways.b from reach join ways on reach.b = ways.a),
least as (select reach.a as r, min(d.doc_id) as component_id from reach join d on reach.b = d.r group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from d left join n on d.r = n.r join least on d.r = least.r
"""


@register
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as archives, read back and assembled to captures."""
    path = scratch_path(spark, "archives")
    write_warc(table(spark, folder, "pages"), path)
    records = materialize(read_warc(spark, path, keep_payload=False), "records")
    return with_origin(assemble(records)).select(
        "page_id", "response.payload_bytes", "response.payload_digest", "response.record_type", "refers_to")


ORACLES["op6_warc"] = """
with p as (select page_id, sha256(coalesce(html, '')) as payload_digest, strlen(coalesce(html, '')) as n from pages),
f as (select payload_digest, min(page_id) as first from p where n >= 100 group by payload_digest)
select page_id, cast(n as bigint) as payload_bytes, p.payload_digest,
  case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to
from p left join f on p.payload_digest = f.payload_digest
"""


@register
def op7_identify_language(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of all documents, learned from two of three folds."""
    docs = table(spark, folder, "documents").withColumn("held_out", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)))
    model = fit(docs.where(fold("doc_id", 3) != 1))
    return identify(docs, model, carry=["doc_id", "held_out"]).select(
        "doc.doc_id", "doc.held_out", "lang_pred", "score", "accepted")


@register
def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents against all 13-word windows of the benchmark."""
    found = scan_benchmark(table(spark, folder, "documents"), table(spark, folder, "benchmark"), carry=["doc_id"])
    return found.select(
        "doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES["op8_decontaminate"] = f"""
with b as (select item_id, {_WORDS} as ws from benchmark where item_id is not null),
bw as (
  select distinct cast(item_id as varchar) as item, least(13, len(ws)) as n,
    array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') as g
  from (select item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) as i from b where len(ws) > 0)),
d as (select row_number() over () as r, doc_id, {_WORDS} as ws from documents),
dw as (
  select r, i, n, array_to_string(ws[i:i + n - 1], ' ') as g
  from (select r, ws, n, unnest(range(1, len(ws) - n + 2)) as i
        from d cross join (select distinct n from bw) where len(ws) >= n)),
hit as (select dw.r, dw.i, dw.n, bw.item from dw join bw on dw.n = bw.n and dw.g = bw.g),
places as (select r, count(distinct p) as n_hit
           from (select r, unnest(range(i, i + n)) as p from (select distinct r, i, n from hit)) group by r),
found as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items
          from (select distinct r, item from hit) group by r)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join places on d.r = places.r left join found on d.r = found.r
"""


URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@register
def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts for all page urls under five rules and the links between pages."""
    return judge_urls(table(spark, folder, "pages"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "component")


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PART = r"coalesce(regexp_extract({}, '(?s)^(.*?)://([^/?#]*)([^?#]*)(\??[^#]*)', {}), '')"


def _address(url: str) -> str:
    scheme, host = (_LOWER.format(_PART.format(url, k)) for k in (1, 2))
    path = _PART.format(url, 3)
    return f"""case when {host} <> '' then concat({scheme}, '://', {host},
      case when {path} = '' then '/' else {path} end, {_PART.format(url, 4)}) end"""


def _best(source: str, url: str, keys: str) -> str:
    return f"""select {keys}, arg_max(concat(h, p), length(concat(h, p))) as rule, arg_max(v, length(concat(h, p))) as verdict
      from {source} join rules on ({_LOWER.format(_PART.format(url, 2))} = h
        or ends_with({_LOWER.format(_PART.format(url, 2))}, concat('.', h)))
        and starts_with({_PART.format(url, 3)}, p) group by {keys}"""


ORACLES["op10_url_filter"] = rf"""
with recursive rules as (select * from (values {_RULES}) as r(v, h, p)),
tags as (
  select url, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'),
      lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''>\s]+)', 1)),
    list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'),
      lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''>;\s]+)', 1)))) as raw
  from pages),
links as (select url, replace(raw, '&amp;', '&') as link from tags where raw <> ''),
resolved as (
  select url, case
    when contains(link, '://') then link
    when starts_with(link, '//') then concat({_PART.format('url', 1)}, ':', link)
    when starts_with(link, '/') then concat({_PART.format('url', 1)}, '://', {_PART.format('url', 2)}, link)
    when not starts_with(link, '#') then concat({_PART.format('url', 1)}, '://', {_PART.format('url', 2)},
      case when contains({_PART.format('url', 3)}, '/') then regexp_extract({_PART.format('url', 3)}, '(?s)^.*/') else '/' end, link)
    end as target from links),
edges as (select {_address('url')} as a, {_address('target')} as b from resolved),
ends as (select a, b from edges where a is not null and b is not null and a <> b
         union select b, a from edges where a is not null and b is not null and a <> b),
reach as (select a as node, a as other from ends union select reach.node, ends.b from reach join ends on reach.other = ends.a),
nodes as (select node, min(other) as component from reach group by node),
judged as ({_best('nodes', 'node', 'node, component')}),
spread as (
  select component, case when bool_or(verdict = 'allow') then 'allow' when bool_or(verdict = 'block') then 'block' else 'allow' end as verdict
  from judged group by component),
own as (select row_number() over () as r, page_id, url, {_address('url')} as node from pages),
ruled as ({_best('own', 'url', 'r')})
select page_id, {_LOWER.format(_PART.format('url', 2))} as host, {_PART.format('url', 3)} as path, rule,
  coalesce(ruled.verdict, spread.verdict, 'allow') as verdict, nodes.component
from own left join ruled on own.r = ruled.r left join nodes on own.node = nodes.node
  left join spread on nodes.component = spread.component
"""


@register
def op9_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest rows of every twentieth embedding."""
    return nearest_vectors(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@register
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every benchmark item, by bit-sliced signatures and exact rescoring."""
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLES["op13_lexical_search"] = f"""
with d as (select row_number() over () as r, doc_id, {_TERMS} as terms from documents),
dn as (select r, doc_id, cast(len(terms) as bigint) as n from d where len(terms) > 0),
stats as (select count(*) as big_n, sum(n)::bigint as big_l from dn),
dt as (select r, term, count(*) as tf from (select r, unnest(terms) as term from d) group by r, term),
q as (select item_id, term, count(*) as cnt from (select item_id, unnest({_TERMS}) as term from benchmark)
      group by item_id, term),
df as (select term, count(*) as df from dt where term in (select term from q) group by term),
w as (select item_id, term, cnt,
        cast(floor(1000 * ln((2 * big_n + 2)::double / (2 * coalesce(df.df, 0) + 1))) as bigint) as w
      from q left join df using (term) cross join stats),
m as (select r, doc_id, 25 + (75 * n * big_n) // big_l as m from dn cross join stats),
s as (select item_id, m.r, m.doc_id,
        sum(cnt * w * ((1000000000 * tf) // (1000 * tf + 8 * m.m)))::bigint as score
      from w join dt using (term) join m on dt.r = m.r group by item_id, m.r, m.doc_id)
select item_id, cast(rank as integer) as rank, doc_id, score from (
  select item_id, doc_id, score,
    row_number() over (partition by item_id order by score desc, doc_id asc nulls last) as rank
  from s where score > 0) where rank <= 10
"""


@register
def op12_lz_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Lempel-Ziv phrase fingerprints of all documents and of their edits by the next document."""
    return fingerprint_texts(table(spark, folder, "documents"))


@register
def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations, one row per node."""
    return conversation_trie(table(spark, folder, "conversations"))


ORACLES["op11_conversation_trie"] = """
with recursive
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
      from conversations where conv_id is not null),
dict as (select role, text, dense_rank() over (order by role, text) as tid from (select distinct role, text from t)),
own as (select conv_id, list(tid order by turn asc nulls first, t.role, t.text) as seq,
          list(strlen(t.text) order by turn asc nulls first, t.role, t.text) as b
        from t join dict using (role, text) group by conv_id),
ids as (select conv_id as c, cast(conv_id as varchar) as s from own),
crc(c, s, i, v) as (
  select c, s, 0, 4294967295::bigint from ids
  union all
  select c, s, i + 1,
    xor((case when i % 8 = 0 then xor(v, ascii(substr(s, i // 8 + 1, 1))) else v end) >> 1,
        case when ((case when i % 8 = 0 then xor(v, ascii(substr(s, i // 8 + 1, 1))) else v end) & 1) = 1
             then 3988292384 else 0 end)
  from crc where i < 8 * length(s)),
hop as (select c, xor(v, 4294967295) % 9 as h from crc where i = 8 * length(s)),
r as (select hop.c,
        list_concat(list_slice(coalesce(bo.seq, list_slice(o.seq, 1, 0)), 1, hop.h), list_slice(o.seq, hop.h + 1, len(o.seq))) as seq,
        list_concat(list_slice(coalesce(bo.b, list_slice(o.b, 1, 0)), 1, hop.h), list_slice(o.b, hop.h + 1, len(o.b))) as b
      from hop join own o on o.conv_id = hop.c left join own bo on bo.conv_id = hop.c - hop.c % 5),
p as (select c, d, list_slice(seq, 1, d) as prefix, len(seq) as n, case when d = 0 then 0 else b[d] end as last_b
      from (select c, seq, b, unnest(range(0, len(seq) + 1)) as d from r)),
nodes as (select prefix, any_value(d) as depth, min(c) as conv_id, count(*) as n_convs, any_value(last_b) as last_b,
            sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where n = d), '')) as ends_sha256
          from p group by prefix),
kids as (select list_slice(prefix, 1, depth - 1) as parent, count(*) as n_children from nodes where depth > 0 group by 1),
wk as (select nodes.*, coalesce(kids.n_children, 0) as n_children from nodes left join kids on kids.parent = nodes.prefix),
sub as (select list_slice(prefix, 1, a) as anc, sum(case when n_children = 0 then 1 else 0 end)::bigint as n_leaves,
          sum((n_convs - 1) * last_b)::bigint as saved_tokens
        from (select *, unnest(range(0, depth + 1)) as a from wk) group by 1)
select wk.conv_id, wk.depth::bigint as depth, par.conv_id as parent_conv_id, wk.n_convs, wk.n_children::bigint as n_children,
  sub.n_leaves, sub.saved_tokens, wk.ends_sha256
from wk join sub on sub.anc = wk.prefix
left join nodes par on wk.depth > 0 and par.prefix = list_slice(wk.prefix, 1, wk.depth - 1)
"""

"""Queries of the training-data problems, by the key under which they are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from switchback.llm import chunks, clusters, leaks, mixing, neardup, neighbours, pii, reading
from switchback.llm.inputs import texts_of
from switchback.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_mentions(texts_of(spark, sf_dir, "inquiries", "hard", "documents")).select("tab", "rec_id", "kind", "start_pos")


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(texts_of(spark, sf_dir, "inquiries", "hard", "documents")).select("tab", "rec_id", "clean_text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, members = neardup.near_duplicates(texts_of(spark, sf_dir, "hard", "documents"), run=3, threshold=0.6)
    return neardup.duplicate_pairs(links, members)


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.duplicate_groups(*neardup.near_duplicates(texts_of(spark, sf_dir, "hard", "documents"), run=3, threshold=0.6))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, sf_dir, "trail_vectors"))


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar(table(spark, sf_dir, "trail_vectors"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.oversized(table(spark, sf_dir, "chunks"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.split_long(table(spark, sf_dir, "chunks")).select("chunk_id", "source", "piece", "text", "words")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(table(spark, sf_dir, "condition_reports")).select("cluster_id", "id")


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.described(table(spark, sf_dir, "condition_reports"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.listed_bands(table(spark, sf_dir, "documents"))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents")).select("doc_id", "language", "level", "band")


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.profile(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


#: Of problem 2 by the definition: runs of three words, pairs that share one, and what both have of what either has.
PAIRS = r"""with recursive x as (select 'hard' as tab, id as rec_id, min(text) as text from hard where text is not null group by id
    union all select 'documents', doc_id::varchar, min(text) from documents where text is not null group by doc_id),
w as (select tab, rec_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from x),
r as (select tab, rec_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as run from w where len(w) >= 3),
n as (select tab, rec_id, count(*) as n from r group by all),
m as (select a.tab as tab, a.rec_id as id_a, b.rec_id as id_b, count(*) as m from r a join r b on a.tab = b.tab and a.run = b.run and a.rec_id < b.rec_id group by all),
p as (select m.tab as tab, id_a, id_b from m join n a on a.tab = m.tab and a.rec_id = id_a join n b on b.tab = m.tab and b.rec_id = id_b where m >= 0.6 * (a.n + b.n - m))"""
P2_SQL = f"{PAIRS} select tab, id_a, id_b from p"

#: Its groups: classes of equal word sequences, and what is reached from each over the pairs.
GROUPS_SQL = f"""{PAIRS},
c as (select tab, rec_id, min(rec_id) over (partition by tab, array_to_string(w, ' ')) as class_id from w where len(w) >= 3),
e as (select distinct p.tab as tab, a.class_id as a, b.class_id as b from (select tab, id_a, id_b from p union all select tab, id_b, id_a from p) p join c a on a.tab = p.tab and a.rec_id = id_a join c b on b.tab = p.tab and b.rec_id = id_b where a.class_id <> b.class_id),
g as (select tab, a, b from e union select g.tab, g.a, e.b from g join e on e.tab = g.tab and e.a = g.b),
f as (select tab, a, min(b) as b from g group by all),
l as (select tab, a, count(*) as links from e group by all)
select c.tab as tab, c.rec_id as rec_id, class_id, least(class_id, coalesce(f.b, class_id)) as group_id, coalesce(links, 0) as links from c left join f on f.tab = c.tab and f.a = class_id left join l on l.tab = c.tab and l.a = class_id"""

#: p3_found by all cosines.
P3_SQL = """
with v as (select id, min(vector::double[]) as v from trail_vectors where vector is not null and len(vector) = 64 and len(list_filter(vector, lambda x: x is null or isnan(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0 group by id),
s as (select a.id as a, b.id as b, list_cosine_similarity(a.v, b.v) as s from v a, v b where a.id <> b.id),
k as (select *, row_number() over (partition by a order by s desc, b) as rank from s)
select distinct least(a, b) as id_a, greatest(a, b) as id_b from k where rank <= 5 and s >= 0.85
"""

#: p4_found by the definition: words, the boundaries between them, and the longest stretch.
P4_SQL = r"""
with x as (select chunk_id, min(text) as text from chunks where text is not null and chunk_id is not null group by chunk_id),
g as (select chunk_id, regexp_extract_all(text, '[^ \t\r\n]+') as w, list_prepend('', regexp_extract_all(regexp_replace(text, '^[ \t\r\n]+', ''), '[ \t\r\n]+')) as gap from x),
u as (select chunk_id, len(w) as n, generate_subscripts(w, 1) as i, unnest(w) as w, unnest(gap[1:len(w)]) as gap from g where len(w) > 200),
e as (select *, regexp_replace(w, '["”’)\]*_'']+$', '') as core from u),
c as (select *, lower(ltrim(rtrim(core, '.'), '(["“‘*_''')) as bare from e),
s as (select *, regexp_matches(w, '[.!?…]+["”’)\]*_'']*$') and (right(core, 1) <> '.' or not (bare = '' or list_contains([ABBREVIATIONS], bare) or regexp_matches(bare, '^[\p{Nd}.,:/#$-]*\p{Nd}$') or regexp_matches(bare, '^\p{L}$'))) as ends from c),
b as (select chunk_id, n, i, i > 1 and (coalesce(lag(ends) over (partition by chunk_id order by i), false) or (regexp_matches(gap, '[\r\n]') and (regexp_matches(gap, '(\r\n|\r|\n)[ \t]*(\r\n|\r|\n)') or regexp_matches(w, '^(-|\*|•|\+|–|·|\d+\.\d+\.?)$')))) as cut from s),
d as (select chunk_id, i - 1 as place from b where cut union all select distinct chunk_id, n from b union all select distinct chunk_id, 0 from b),
l as (select chunk_id, place - lag(place) over (partition by chunk_id order by place) as stretch from d)
select chunk_id, case when max(stretch) > 180 then 'forced' else 'clean' end as cut from l group by chunk_id
""".replace("ABBREVIATIONS", ", ".join(f"'{a}'" for a in sorted(chunks.ABBREVIATIONS)))


#: The pieces one after another: the last boundary within reach that lies after what is covered, or the limit.
PIECES_SQL = P4_SQL[: P4_SQL.index("d as (select chunk_id, i - 1")].replace("with x as (select chunk_id, min(text)", "with recursive x as (select chunk_id, min(source) as source, min(text)").replace("(select chunk_id, regexp_extract_all", "(select chunk_id, source, text, regexp_extract_all") + """
k as (select chunk_id, max(n) as n, coalesce(list(i - 1 order by i) filter (cut), []) as cuts from b group by chunk_id),
z as (select chunk_id, n, cuts, 0 as piece, 0::bigint as start, coalesce(list_max(list_filter(cuts, lambda v: v > 0 and v <= 200)), 200) as stop from k
  union all select chunk_id, n, cuts, piece + 1, greatest(stop - 20, 0), case when n - greatest(stop - 20, 0) <= 200 then n else coalesce(list_max(list_filter(cuts, lambda v: v > stop and v <= greatest(stop - 20, 0) + 200)), greatest(stop - 20, 0) + 200) end from z where stop < n)
select chunk_id, source, piece, array_to_string(list_transform(range(start + 1, stop + 1), lambda j: case when j > start + 1 then gap[j] else '' end || w[j]), '') as text, (stop - start)::int as words from z join g using (chunk_id)
union all select chunk_id, source, 0, text, len(w)::int from g where len(w) between 1 and 200
"""


def listed(words: str | tuple[str, ...] | frozenset[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words.split("|") if isinstance(words, str) else words))) + "]"


#: p8_found by the bounds of the definition, which the ranker never asks outside its sample: tokens of the prose with the gap after each.
P8_SQL = r"""
with a as (select doc_id, regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x{200b}-\x{200f}\x{ad}\x{2060}\x{feff}]', '', 'g') as t from documents where text is not null),
b as (select doc_id, regexp_replace(t, '\A\s*---[ \t]*\n(?s:.*?)\n---[ \t]*(\n|\z)', '') as t from a),
c as (select doc_id, regexp_replace(t, '(?m)^[ \t]{0,3}#{1,6}[ \t].*$', chr(10), 'g') as t from b),
p as (select doc_id, regexp_replace(chr(10) || t, '\n(?:[ \t]|>)*(?:[-*•+][ \t]+|\d+[.)][ \t]+|\d+\.\d+[ \t]+)?', chr(10), 'g') as t from c),
q as (select doc_id, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) as letters, regexp_extract_all(t, '[^ \t\n\x0b\f\r]+') as w, list_append(regexp_extract_all(regexp_replace(t, '\A[ \t\n\x0b\f\r]+', ''), '[ \t\n\x0b\f\r]+'), '') as gap from p),
u as (select doc_id, letters, generate_subscripts(w, 1) as i, len(w) as n, unnest(w) as w, unnest(gap[1:len(w)]) as gap from q),
x as (select *, lower(w) as low, trim(lower(w), SIGNS) as bare, lead(w) over (partition by doc_id order by i) as after from u),
m as (select doc_id, letters, (low not in (select unnest(NO_WORDS)))::int as word, regexp_matches(w, '[.!?…]+["''”’)\]]*$')::int as mark,
  coalesce((regexp_matches(w, '(?i)(^|[^\w])(ca|approx|rd|mt|e\.g|i\.e|vs|mr|mrs|ms|dr|st|no|ft|mi|[ap]\.m)\.$') and (regexp_matches(after, '^[0-9(a-z]') or (length(gap) = 1 and regexp_matches(after, '^\p{L}') and regexp_matches(w, '(?i)(mt|st|rd|dr|mr)\.$'))))::int, 0) as inside,
  (regexp_matches(w, '[\p{L}0-9,;:]$') and (i = n or regexp_matches(gap, '^[ \t]*\n[ \t]*\n')))::int as loose,
  list_contains(ENGLISH, bare)::int as en, list_contains(SPANISH, bare)::int as es, list_contains(GERMAN, bare)::int as de from x),
d as (select doc_id, sum(word) as n, max(letters) as letters, greatest(1, sum(mark) - sum(inside) + sum(loose)) as sentences, sum(en * word) as en, sum(es * word) as es, sum(de * word) as de from m group by doc_id),
e as (select doc_id, n / sentences as words, letters / n as letters from d where n > 0 and en >= es and en >= de and en > 0)
select doc_id, case when words < 9 and letters < 4 then 'easy' else 'demanding' end as band from e where (words < 9 and letters < 4) or (words > 22 and letters > 5.2)
"""
for _name, _said in (("NO_WORDS", listed(reading.NO_WORDS)), ("SIGNS", "'" + reading.SIGNS.replace("'", "''") + "'"), ("ENGLISH", listed(reading.ENGLISH)), ("SPANISH", listed(reading.SPANISH)), ("GERMAN", listed(reading.GERMAN))):
    P8_SQL = P8_SQL.replace(_name, _said)


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p2_groups": GROUPS_SQL, "p3_found": P3_SQL, "p4_found": P4_SQL, "p4_pieces": PIECES_SQL, "p8_found": P8_SQL}

"""DuckDB SQL for the operators that SQL can express; the others are tested
against brute force. Each is written from the query's definition, with plain
joins over all rows."""

from __future__ import annotations

from vitalspark.llm.centroids import CLUSTERS, DIM, ROUNDS, SCALE, SEED

WHITE = r"\x20\x09-\x0D"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def clustering() -> str:
    """Lloyd rounds, one after the other, over (vector, dimension) rows."""
    steps = [
        f"""kept as materialized (
  select row_number() over () as r, vec_id,
    list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v
  from embeddings
  where len(embedding) = {DIM}
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIM}),
cells as materialized (
  select r, d, v[d] as x from kept, (select unnest(range(1, {DIM + 1})) as d)),
centres_0 as materialized (
  select j, d, v[d] as c from (
    select row_number() over (order by h, v) - 1 as j, v from (
      select v, sha256('{SEED}:' || coalesce(vec_id::varchar, '')) as h from kept)
    qualify row_number() over (order by h, v) <= {CLUSTERS}),
  (select unnest(range(1, {DIM + 1})) as d))"""
    ]
    for t in range(ROUNDS + 1):
        steps.append(f"""near_{t} as materialized (
  select r, j, s from (
    select r, j, sum((x - c) * (x - c))::bigint as s from cells join centres_{t} using (d) group by r, j)
  qualify row_number() over (partition by r order by s, j) = 1)""")
        if t < ROUNDS:
            steps.append(f"""centres_{t + 1} as materialized (
  select o.j, o.d, coalesce(m.c, o.c) as c from centres_{t} o left join (
    select j, d, floor(sum(x)::double / count(*))::bigint as c
    from near_{t} join cells using (r) group by j, d) m on o.j = m.j and o.d = m.d)""")
    return (
        "with "
        + ",\n".join(steps)
        + f"""
select k.vec_id, n.j::integer as cluster, n.s as distance,
  (sum(n.s) over (partition by n.j))::bigint as cluster_inertia, (sum(n.s) over ())::bigint as inertia, h.centroid_sha256
from near_{ROUNDS} n join kept k using (r)
join (select j, sha256(string_agg(c::varchar, ',' order by d)) as centroid_sha256 from centres_{ROUNDS} group by j) h on h.j = n.j"""
    )


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

LEXICAL = f"""with words as materialized (
  select rowid as r, doc_id, unnest(regexp_extract_all({LOWER.format('text')}, '{TERM}')) as term
  from (select row_number() over () as rowid, doc_id, text from documents)),
lengths as (select r, count(*) as n from words group by r),
totals as (select count(*) as N, sum(n)::bigint as L from lengths),
norms as (select r, 100 - 25 + (25 * n * (select N from totals)) // (select L from totals) as m from lengths),
counts as materialized (select r, any_value(doc_id) as doc_id, term, count(*) as tf from words group by r, term),
weights as (
  select term, floor(1000 * ln((2 * (select N from totals) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from counts group by term),
asked as (select i, item_id, unnest(regexp_extract_all({LOWER.format('text')}, '{TERM}')) as term
  from (select row_number() over () as i, item_id, text from benchmark)),
scored as (
  select i, any_value(item_id) as item_id, r, any_value(doc_id) as doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from asked join counts using (term) join weights using (term) join norms using (r)
  group by i, r),
ranked as (
  select i, item_id, doc_id, score, row_number() over (partition by i order by score desc, doc_id asc nulls last) as rank
  from scored where score > 0)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= 20"""

LINES = f"""with split as materialized (
  select r, doc_id, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as nr
  from (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents)),
keyed as materialized (
  select r, doc_id, line, nr,
    {LOWER.format(f"regexp_replace(regexp_replace(line, '^[{WHITE}]+', ''), '[{WHITE}]+$', '')")} as key from split),
repeated as (
  select key, max(doc_id) as top from keyed where length(key) >= 20
  group by key having count(distinct coalesce(doc_id::varchar, '')) >= 3),
marked as (
  select r, k.doc_id, line, nr, p.key is not null and k.doc_id is distinct from p.top as gone
  from keyed k left join repeated p on k.key = p.key)
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by nr) filter (where not gone), '')) as kept_sha256
from marked group by r"""

NGRAMS = f"""with recursive texts as materialized (
  select doc_id, list_filter(string_split_regex({LOWER.format('text')}, '[{WHITE}]+'), lambda x: x <> '') as w
  from documents where text is not null),
grams as materialized (
  select distinct doc_id, case when len(w) < 4 then w else w[i : i + 3] end as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from texts where len(w) > 0)),
sizes as materialized (select doc_id, count(*) as n from grams group by doc_id),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as shared
  from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as materialized (
  select x, y from pairs join sizes s on s.doc_id = x join sizes t on t.doc_id = y
  where 100 * shared >= 85 * (s.n + t.n - shared)),
ways as materialized (select x, y from links union all select y, x from links),
reach as (select doc_id as x, doc_id as root from sizes union select w.y, r.root from reach r join ways w on w.x = r.x),
roots as (select x, min(root) as root from reach group by x)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, coalesce(r.root, d.doc_id) as component_id
from documents d left join sizes s on s.doc_id = d.doc_id left join roots r on r.x = d.doc_id"""

ORACLE_SQL: dict[str, str] = {
    "op10_ngram_join": NGRAMS,
    "op11_centroids": clustering(),
    "op12_lexical_search": LEXICAL,
    "op13_line_dedup": LINES,
}

"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

WORDS = "coalesce(nullif(string_split_regex(trim(coalesce(text, ''), E' \\t\\n\\x0b\\x0c\\r'), '[\\x20\\x09-\\x0D]+'), ['']), [])"

OP7 = """with d as (select page_id, coalesce(html, '') as h from pages),
s as (select page_id, strlen(h)::bigint as payload_bytes, sha1(h) as hex from d),
b as (select *, max(page_id) over (partition by hex) as keeper,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (i // 8 * 10 + 1)::bigint, 10))::bigint >> (35 - 5 * (i % 8))) & 31) + 1)::bigint, 1)), '') as payload_digest from s)
select page_id, payload_bytes, payload_digest, case when keeper = page_id then 'response' else 'revisit' end as record_type, case when keeper <> page_id then keeper end as refers_to from b"""

OP8 = f"""with d as (select doc_id, {WORDS} as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
hit as (select doc_id, i from (select *, min(doc_id) over (partition by h) as first from win) where first < doc_id),
pos as (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d),
cov as (select pos.doc_id, p, w[p] as word, max(hit.i) over (partition by pos.doc_id order by p rows between 49 preceding and current row) is null as keep from pos left join hit on hit.doc_id = pos.doc_id and hit.i = p),
kept as (select doc_id, count(*) as n_words, count(*) filter (not keep) as n_removed, sha256(coalesce(string_agg(word, ' ' order by p) filter (keep), '')) as kept_sha256 from cov group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, coalesce(kept_sha256, sha256('')) as kept_sha256 from d left join kept using (doc_id)"""

OP9 = f"""with d as (select doc_id, coalesce(text, '') as t, {WORDS} as w from documents),
g as (select doc_id, i, md5(array_to_string(w[i : i + 4], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
r as (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from (select *, count(*) over (partition by doc_id, h) as c from g) where c > 1),
rep as (select doc_id, sum(least(5, coalesce(nxt - i, 5)))::bigint as n from r group by doc_id),
m as (select d.doc_id, t, w, len(w)::bigint as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words from (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d) d left join rep using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not (n_symbols > 0.2 * n_words or word_chars < 2 * n_words or word_chars > 25 * n_words
  or (n_words >= 20 and 2 * length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) > length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g'))) or 5 * len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) > n_words
  or (n_dup_lines >= 3 and 2 * n_dup_lines > len(string_split(t, chr(10))))) as kept from b"""

WHOLE = "list_transform(embedding, lambda x: floor(1024 * x::double)::bigint)"
SOUND = "embedding is not null and len(embedding) = len(list_filter(embedding, lambda x: x is not null and isfinite(x)))"


def _codes(rounds: int = 4, width: int = 16) -> str:
    """Product quantisation, a row for each vector, part and position."""
    steps = [f"""with kept as materialized (select vec_id, label, {WHOLE} as v, row_number() over (order by vec_id) - 1 as place from embeddings where {SOUND}),
w as materialized (select vec_id, place, (i - 1) // {width} as p, (i - 1) % {width} as j, v[i] as x from (select *, unnest(range(1, len(v) + 1)) as i from kept)),
b0 as materialized (select p, place as e, j, x as c from w where place < 256)"""]
    nearest = "select vec_id, p, min(d * 256 + e) as best from (select vec_id, p, e, sum((x - c) * (x - c)) as d from w join {0} using (p, j) group by all) group by all"
    for r in range(rounds):
        steps.append(f"""a{r} as materialized ({nearest.format(f"b{r}")}),
b{r + 1} as materialized (select o.p, o.e, o.j, coalesce(m.c, o.c) as c from b{r} o left join (select p, best % 256 as e, j, (sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) as c from w join a{r} using (vec_id, p) group by all) m using (p, e, j))""")
    steps.append(f"""a as materialized ({nearest.format(f"b{rounds}")}),
t as (select vec_id, string_agg(format('{{:02x}}', (best % 256)::bigint), '' order by p) as code, sum(best // 256)::bigint as error from a group by vec_id)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select sha256(string_agg(c::bigint::varchar, ',' order by p, e, j)) from b{rounds}) as codebooks_sha256 from t join kept using (vec_id)""")
    return ",\n".join(steps)


def _centroids(rounds: int = 10) -> str:
    steps = [f"""with kept as materialized (select vec_id, {WHOLE} as v from embeddings where len(embedding) = 64 and {SOUND}),
c0 as materialized (select row_number() over (order by sha256('3:' || vec_id)) - 1 as k, v as c from kept qualify k < 8)"""]
    nearest = "select vec_id, any_value(v) as v, arg_min(k, d * 8 + k) as k, min(d) as d from (select vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from kept, {0}) group by vec_id"
    for r in range(rounds):
        steps.append(f"""a{r} as materialized ({nearest.format(f"c{r}")}),
c{r + 1} as materialized (select o.k, coalesce(m.c, o.c) as c from c{r} o left join (select k, list(((s - (s % n + n) % n) // n)::bigint order by i) as c from (select k, i, sum(v[i]) as s, count(*) as n from (select *, unnest(range(1, 65)) as i from a{r}) group by k, i) group by k) m using (k))""")
    steps.append(f"""a as materialized ({nearest.format(f"c{rounds}")})
select vec_id, a.k::int as cluster, d as distance, (sum(d) over (partition by a.k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256 from a join c{rounds} using (k)""")
    return ",\n".join(steps)


#: For pages that mark their article; what is shared with other pages plays no part in those.
OP13 = r"""with a as (select page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(p|h1)>', chr(1), 'g') as h from pages),
b as (select page_id, url, list_filter(list_transform(string_split(h, chr(1)), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') as l from a),
c as (select page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(l, chr(10) || chr(10)), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#(x27|39);', chr(39), 'g'), '&amp;?', '&', 'g') as text from b)
select page_id, url, text, length(text)::bigint as n_chars from c"""

ORACLE_SQL = {"op7_warc": OP7, "op8_substring_dedup": OP8, "op9_quality_rules": OP9, "op11_vector_codes": _codes(), "op12_centroids": _centroids(), "op13_html_extraction": OP13}

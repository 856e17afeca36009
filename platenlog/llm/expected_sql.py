"""The same results as SQL, where SQL can express them."""

from __future__ import annotations

CHAT = """
with rows_ as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all
    select -1, t.turn, t.role, '<|im_end|><|im_start|>assistant ok'
    from (values (0, 'user'), (1, 'assistant')) t(turn, role)
), marked as (
    select *, lag(role) over w as before_,
        length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) as body,
        length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) as name_
    from rows_ window w as (partition by conv_id order by turn, role, text)
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    -- 12 and 1 around a role, 10 and 1 at the end of a block, 11 between merged turns
    cast(sum(body + case when before_ = role then 11 else 24 + name_ end) as bigint) as formatted_chars
from marked group by conv_id
"""


def packing_sql(max_len: int, buckets: int, budget: int) -> str:
    """Dynamic programming over the histogram, one step a bucket."""
    steps = []
    for k in range(2, buckets + 1):
        steps.append(f"""
d{k} as materialized (
    select j.i, least(b.best, coalesce(c.best, b.best)) as best, case when c.best < b.best then c.cut end as cut
    from cum j join d{k - 1} b on b.i = j.i left join (
        select to_.i, min(p.best + (to_.upto - from_.upto) * to_.n_tokens) as best,
            arg_min(from_.i, (p.best + (to_.upto - from_.upto) * to_.n_tokens) * 100000 + from_.i) as cut
        from cum to_ join cum from_ on from_.i < to_.i join d{k - 1} p on p.i = from_.i group by to_.i) c on c.i = j.i
)""")
    back = ["b%d as (select max(i) as i from cum)" % buckets]
    for k in range(buckets, 1, -1):
        back.append(
            f"b{k - 1} as (select coalesce(d.cut, b.i) as i from b{k} b left join d{k} d on d.i = b.i)"
        )
    bounds = " union ".join(f"select i from b{k}" for k in range(buckets, 0, -1))
    return f"""
with lens as (
    select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 as n from documents
), pieces as (
    select doc_id, n, unnest(range(0, (n - 1) // {max_len} + 1)) as piece from lens
), seqs as (
    select doc_id, piece, piece * {max_len} as first_word, least({max_len}, n - piece * {max_len}) as n_tokens from pieces
), hist as (select n_tokens, count(*) as c from seqs group by n_tokens),
cum as materialized (
    select n_tokens, row_number() over (order by n_tokens) as i,
        cast(sum(c) over (order by n_tokens) as bigint) as upto from hist
),
d1 as (select i, upto * n_tokens as best, null::bigint as cut from cum),
{",".join(steps)},
{", ".join(back)},
bounds as (
    select n_tokens as bucket_len, row_number() over (order by n_tokens) - 1 as bucket
    from cum where i in ({bounds})
), placed as (
    select s.*, (select min(b.bucket) from bounds b where b.bucket_len >= s.n_tokens) as bucket from seqs s
), numbered as (
    select p.*, b.bucket_len, greatest(1, {budget} // b.bucket_len) as rows_,
        row_number() over (partition by p.bucket
            order by md5(coalesce(doc_id::varchar, '') || ':' || piece), doc_id, piece, n_tokens) - 1 as number_
    from placed p join bounds b using (bucket)
)
select doc_id, piece, first_word, n_tokens, cast(bucket as int) as bucket, bucket_len,
    number_ // rows_ as batch, number_ % rows_ as place
from numbered
"""

DECONTAMINATION = r"""
with d as (
    select doc_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from documents
), i as (
    select item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from benchmark
), ds as (
    select distinct doc_id, array_to_string(w[k:k + 4], ' ') as s from (
        select doc_id, w, unnest(range(1, len(w) - 3)) as k from d)
), its as (
    select distinct item_id, array_to_string(w[k:k + 4], ' ') as s from (
        select item_id, w, unnest(range(1, len(w) - 3)) as k from i)
), sizes as (select item_id, count(*) as n_shingles from its group by item_id)
select ds.doc_id, its.item_id, count(*) as n_shared, n_shingles, count(*) / n_shingles as containment
from ds join its using (s) join sizes using (item_id)
group by ds.doc_id, its.item_id, n_shingles having count(*) >= ceil(0.8 * n_shingles - 1e-9)
"""

# A line goes if an equal or (from 20 characters up) one-edit line comes earlier; pairs one
# edit apart agree on the first or on the last half of the longer one.
LINES = """
with docs_ as (
    select row_number() over () as r, doc_id, text, string_split(coalesce(text, ''), chr(10)) as ls from documents
), all_ as (
    select r, doc_id, unnest(ls) as line, unnest(range(len(ls))) as n from docs_
), occ as (
    select *, row_number() over (order by doc_id, n) as at_ from all_ where trim(line, ' ') <> ''
), uniq as materialized (
    select line, min(at_) as first_, length(line) as len_ from occ group by line
), halves as materialized (
    select line, first_, len_, t, side,
        case side when 0 then left(line, t // 2) else right(line, t - t // 2) end as half
    from uniq, (values (0), (1)) s(side), lateral (select unnest([len_, len_ + 1]) as t) where len_ >= 20
), pairs as (
    select distinct x.line as a, y.line as b
    from halves x join halves y using (t, side, half)
    where x.first_ > y.first_ and greatest(x.len_, y.len_) = t
), near as (
    select distinct a as line from pairs
    where len(list_filter(range(0, greatest(length(a), length(b))), lambda p:
        left(a, p) = left(b, p) and (
            (length(a) = length(b) and substr(a, p + 2) = substr(b, p + 2))
            or (length(a) = length(b) + 1 and substr(a, p + 2) = substr(b, p + 1))
            or (length(b) = length(a) + 1 and substr(b, p + 2) = substr(a, p + 1))))) > 0
), judged as (
    select o.r, o.n, o.line, (o.at_ > u.first_ or x.line is not null) as gone
    from occ o join uniq u using (line) left join near x using (line)
), parts as (
    select a.r, a.n, a.line, coalesce(j.gone, false) as gone from all_ a left join judged j on j.r = a.r and j.n = a.n
)
select d.doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
    sha256(coalesce(string_agg(line, chr(10) order by n) filter (not gone), '')) as kept_sha256
from parts join docs_ d using (r) group by d.r, d.doc_id
"""

DIVERGENCE = r"""
with docs_ as (
    select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts
    from documents
), words as materialized (
    select r, lang, source, t, count(*) as n from (select r, lang, source, unnest(ts) as t from docs_) group by all
), kept as materialized (select lang, t, sum(n) as n from words group by lang, t having count(*) >= 30),
counts as materialized (select w.lang, w.source, w.t, sum(w.n) as n from words w join kept using (lang, t) group by all),
groups_ as (select distinct lang, source from docs_),
langs as (select lang, count(*) as v, sum(n) as n from kept group by lang),
sized as materialized (
    select g.lang, g.source, coalesce(l.v, 0) as v, l.n as lang_n,
        coalesce((select sum(c.n) from counts c where c.lang = g.lang and c.source = g.source), 0) as n
    from groups_ g left join langs l using (lang)
), shares as materialized (
    select s.lang, s.source, k.t, coalesce(c.n, 0) as n,
        1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)::hugeint) // (s.n + 5 * s.v)::hugeint as p,
        1 + (1000000000::hugeint * (k.n + 5)::hugeint) // (s.lang_n + 5 * s.v)::hugeint as q
    from sized s join kept k using (lang) left join counts c on c.lang = s.lang and c.source = s.source and c.t = k.t
), apart as (
    select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
    from shares a join shares b on a.lang = b.lang and a.t = b.t and a.source <> b.source group by all
), pairs as (
    select a.lang, a.source, b.source as item, coalesce(x.value, 0) as value
    from groups_ a join groups_ b on a.lang = b.lang and a.source <> b.source
    left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source
), all_ as (
    select lang, source, 'pair' as part, item, cast(value as bigint) as value from pairs
    union all
    select lang, source, 'term', t, cast(p - q as bigint) from shares where n > 0 and p > q
), ranked as (
    select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from all_
)
select lang, source, part, item, value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= 50
"""

NEGATIVES = """
with rows_ as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings
    where label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same,
        list_sum(list_transform(list_zip(a.v, r.v), lambda x: x[1] * x[2])) as score
    from rows_ a join rows_ r on a.vec_id % 100 = 0 and r.vec_id <> a.vec_id and len(r.v) = len(a.v)
), positives as (
    select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as k from scored where same)
    where k <= 5
), found as (
    select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
        row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) as rank
    from positives p join scored n on n.anchor_id = p.anchor_id and not n.same
        and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, cast(positive_score as bigint) as positive_score,
    cast(negative_score as bigint) as negative_score
from found where rank <= 10
"""

EXPECTED = {
    "op1_packing": packing_sql(2048, 8, 16_384),
    "op6_chat": CHAT,
    "op8_lines": LINES,
    "op10_decontamination": DECONTAMINATION,
    "op12_divergence": DIVERGENCE,
    "op13_negatives": NEGATIVES,
}

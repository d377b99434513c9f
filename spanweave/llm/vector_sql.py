"""SQL of the queries over shards and codes, written out from their parameters."""

from __future__ import annotations

from spanweave.llm.shards import BITS, SHARDS

_TOP = (1 << BITS) - 1


def _curve(n: int, bits: int) -> str:
    """CTEs c0, c1, ... that turn the places x0, x1, ... of ``placed`` into their index h on the curve, in ``curve``."""
    own = [f"x{i}" for i in range(n)]
    steps, last = [], "placed"
    for b in range(bits - 1, 0, -1):
        for i in range(n):
            q = 1 << b
            flip = f"case when x{i} & {q} <> 0 then {q - 1} else xor(x0, x{i}) & {q - 1} end"
            new = [f"xor(x0, {flip}) as x0", *[f"case when {k} = {i} and x{i} & {q} = 0 then xor(x{i}, xor(x0, x{i}) & {q - 1}) else x{k} end as x{k}" for k in range(1, n)]]
            steps.append(f"c{len(steps)} as (select doc_id, size, text_crc32, {', '.join(new)} from {last})")
            last = f"c{len(steps) - 1}"
    gray, g = [], own[0]
    for k in range(1, n):
        gray.append(g)
        g = f"xor({g}, x{k})"
    gray.append(g)
    turn = "0"
    for b in range(1, bits):
        turn = f"xor({turn}, case when x{n - 1} & {1 << b} <> 0 then {(1 << b) - 1} else 0 end)"
    woven = " + ".join(f"(((xor(x{k}, turn) >> {b}) & 1) << {b * n + n - 1 - k})" for k in range(n) for b in range(bits))
    return f"""{', '.join(steps)},
gray as (select doc_id, size, text_crc32, {', '.join(f'{e} as x{k}' for k, e in enumerate(gray))} from {last}),
turned as (select *, {turn} as turn from gray),
curve as (select doc_id, size, text_crc32, {woven} as h from turned)"""


def _codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    def nearest(r: int) -> str:
        """The entry of each part, by the codebooks of round r."""
        return f"""d{r} as (select id, label, part, n, k, list_sum(list_transform(list_zip(v, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from parts join book{r} using (part)),
a{r} as materialized (select id, label, part, n, arg_min(k, (d, k)) as k, min(d)::bigint as d from d{r} group by id, label, part, n)"""

    steps = []
    for r in range(rounds):
        steps += [nearest(r), f"""m{r} as (select part, k, j, floor(sum(v[j]) / count(*))::bigint as e from a{r} join parts using (id, part, n), range(1, {64 // parts + 1}) as t(j) group by part, k, j),
new{r} as (select part, k, list(e order by j) as e from m{r} group by part, k),
book{r + 1} as materialized (select part, k, coalesce(new{r}.e, book{r}.e) as e from book{r} left join new{r} using (part, k))"""]
    return f"""with whole as (select vec_id as id, label, list_transform(embedding, lambda c: floor(c::double * {scale})::bigint) as x, row_number() over (order by vec_id) as n from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
parts as materialized (select id, label, n, p as part, x[p * (len(x) // {parts}) + 1:(p + 1) * (len(x) // {parts})] as v from whole, range({parts}) as t(p)),
book0 as (select part, n - 1 as k, v as e from parts where n <= {entries}),
{', '.join(steps)}, {nearest(rounds)},
told as (select id, label, string_agg(printf('%02x', k), '' order by part) as code, sum(d)::bigint as error from a{rounds} group by id, label, n),
labels_ as (select label, sum(error)::bigint as label_error from told group by label)
select id as vec_id, code, error, label_error, (select sha256(string_agg(array_to_string(e, ','), ',' order by part, k)) from book{rounds}) as codebooks_sha256
from told join labels_ on told.label is not distinct from labels_.label"""


SQL = {
    "op11_hilbert_shards": rf"""
with crc as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
own as (select doc_id, lang, source, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::bigint) as bytes from documents),
measured as (select doc_id, lang, source, len(bytes) + 8 as size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) as text_crc32 from own, crc),
ranks as (select doc_id, size, text_crc32, length(bin(size)) - 1 as e, dense_rank() over (order by lang nulls first) - 1 as l, dense_rank() over (order by source nulls first) - 1 as s from measured),
placed as (select doc_id, size, text_crc32, (l * {_TOP + 1} // (select max(l) + 1 from ranks))::bigint as x0, (s * {_TOP + 1} // (select max(s) + 1 from ranks))::bigint as x1,
  least({_TOP}, 4 * (e - 1) + ((size >> (e - 2)) & 3))::bigint as x2 from ranks),
{_curve(3, BITS)},
ranked as (select *, row_number() over (order by h, doc_id nulls first, text_crc32) - 1 as r, count(*) over () as n from curve),
cut as (select *, r * {SHARDS} // n as s from ranked)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'rows' as law, s::integer as shard, (r - (s * n + {SHARDS - 1}) // {SHARDS})::bigint as slot, null::integer as grown_shard from cut""",
    "op13_vector_codes": _codes(),
}

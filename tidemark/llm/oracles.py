"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _uniform(seed: int, *parts: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *(f"coalesce({p}::varchar, 'null')" for p in parts)])
    return f"('0x' || substr(md5({text}), 1, 15))::bigint"


def warc() -> str:
    return """
        with p as (
            select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes from pages
        ), q as (select *, min(page_id) over (partition by html) as original from p)
        select page_id, payload_bytes, sha256(html) as payload_digest,
               case when payload_bytes >= 100 and original <> page_id then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 100 and original <> page_id then original end as refers_to
        from q
    """


def quality() -> str:
    return rf"""
        with d as (select doc_id, source, coalesce(text, '') as text, {_WORDS} as ws from documents),
        w as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from d),
        t as (select doc_id, i, w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o as t from w window o as (partition by doc_id order by i)),
        r as (select doc_id, i, count(*) over (partition by doc_id, t) as n from t where t is not null),
        rep as (select doc_id, count(distinct i) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as i from r where n > 1) group by doc_id),
        l0 as (select doc_id, source, ws, unnest(string_split(text, chr(10))) as line from d),
        l as (select doc_id, source, ws, line, regexp_extract_all(translate(line, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as norm from l0
              where regexp_matches(line, '[^\x20\x09-\x0D]')),
        dup as (select doc_id, count(*) - count(distinct line) as n_dup_lines from l group by doc_id),
        hosts as (select source, greatest(4, 0.05 * count(distinct ws)) as most from d group by source),
        common as (select l.source, norm from l join hosts h on h.source = l.source group by l.source, norm, most having count(distinct ws) > most),
        lost as (select l.doc_id, sum(len(l.norm)) as lost_words from l join common c on c.source = l.source and c.norm = l.norm group by l.doc_id),
        f as (
            select d.doc_id, len(ws)::bigint as n_words, coalesce((select sum(length(w)) from w where w.doc_id = d.doc_id), 0)::bigint as word_chars,
                   (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
                   coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(lost_words, 0)::bigint as lost_words
            from d left join rep on rep.doc_id = d.doc_id left join dup on dup.doc_id = d.doc_id left join lost on lost.doc_id = d.doc_id)
        select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
               not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_words - lost_words >= 0.5::double * n_words and n_words - lost_words >= 50 as kept
        from f
    """


def substring() -> str:
    return f"""
        with d as (select doc_id, {_WORDS} as ws from documents),
        w as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from d),
        k as (select doc_id, i, {" || ' ' || ".join(f"lead(w, {j}) over o" if j else "w" for j in range(13))} as k from w window o as (partition by doc_id order by i)),
        f as (select doc_id, i, min(doc_id) over (partition by k) as first_doc from k where k is not null),
        gone as (select distinct doc_id, unnest(generate_series(i, i + 12)) as i from f where first_doc < doc_id),
        kept as (select w.doc_id, string_agg(w, ' ' order by w.i) as kept, count(*) as n from w left join gone g on g.doc_id = w.doc_id and g.i = w.i
                 where g.i is null group by w.doc_id)
        select d.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from d left join kept k on k.doc_id = d.doc_id
    """


def mixing(shards: int = 16, per_shard: int = 64, seed: int = 5) -> str:
    key = "coalesce('=' || source, '')"
    tree = []
    for level in range((shards - 1).bit_length()):
        came = f"n{level - 1}" if level else "blocks"
        tree.append(f"""
        r{level} as (select *, row_number() over (partition by lo, hi order by {_uniform(seed + 100 + level, 'skey', 'block')}, skey, block) as drawn,
                     count(*) over (partition by lo, hi) as n, lo + (hi - lo) // 2 as mid from {came}),
        n{level} as (select skey, block, case when hi - lo = 1 or drawn <= n * (mid - lo) // (hi - lo) then lo else mid end as lo,
                     case when hi - lo = 1 then hi when drawn <= n * (mid - lo) // (hi - lo) then mid else hi end as hi from r{level})""")
    last = f"n{(shards - 1).bit_length() - 1}"
    return f"""
        with d as (select doc_id, source, {key} as skey, len({_WORDS})::bigint as size, md5(coalesce(text, '')) as digest from documents),
        u as (select *, {_uniform(seed, 'doc_id', 'digest')} as u from d),
        s as (select skey, source, sum(size)::bigint as source_size from u group by all),
        s1 as (select *, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight, 3.0::double * source_size as cap, sum(source_size) over () as total from s),
        s2 as (select *, cap / weight as full_at, sum(weight) over () as weights from s1),
        s3 as (select *, (total - coalesce(sum(cap) over o, 0)) / (weights - coalesce(sum(weight) over o, 0)) as level from s2
               window o as (order by full_at, skey rows between unbounded preceding and 1 preceding)),
        water as (select coalesce(arg_min(level, full_at), 0.0) as water from s3 where full_at > level),
        t as (select skey, source_size, least(cap, weight * water) as target, round(least(cap, weight * water))::bigint as due, total from s3, water),
        q as (select *, ceil(due / greatest(1, ceil(total / {shards * per_shard}::double)))::bigint as n_blocks from t),
        blocks as (select skey, unnest(generate_series(0, n_blocks - 1)) as block, 0 as lo, {shards} as hi from q where n_blocks > 0), {",".join(tree)},
        line as (select *, coalesce(sum(size) over (partition by skey order by u, doc_id, size rows between unbounded preceding and 1 preceding), 0) as pos from u),
        x as (select l.*, q.source_size, q.target, q.due, q.n_blocks, case when q.source_size > 0 then q.due // q.source_size else 0 end as full_ from line l join q on q.skey = l.skey),
        y as (select *, greatest(0, least(size, due - full_ * source_size - pos)) as cut from x),
        z as (select *, full_ * size + cut as taken, case when size > 0 then full_ + case when cut > 0 then 1 else 0 end else 0 end as copies from y),
        c as (select doc_id, digest, skey, n_blocks, due, unnest(generate_series(0, copies - 1)) as copy_no, source_size, pos from z where copies > 0),
        p as (select c.doc_id, string_agg(b.lo::varchar, ',' order by copy_no) as shards,
                     string_agg({_uniform(seed + 50, 'doc_id', 'digest', 'copy_no')}::varchar, ',' order by copy_no) as orders from c
              join {last} b on b.skey = c.skey and b.block = least(floor((copy_no * source_size + pos) * n_blocks / due::double)::bigint, n_blocks - 1) group by c.doc_id)
        select z.doc_id, z.source, size, z.source_size, target, taken::bigint as taken, copies::integer as copies, coalesce(shards, '') as shards, coalesce(orders, '') as orders
        from z left join p on p.doc_id = z.doc_id
    """


def lines() -> str:
    return rf"""
        with d as (select doc_id, string_split(text, chr(10)) as ls from documents),
        l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from d),
        w as (select doc_id, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as ws from l),
        r as (select *, row_number() over (partition by ws order by doc_id nulls last, i) as nth from w),
        c as (select *, array_to_string(ws, ' ') as k, row_number() over (order by doc_id nulls last, i) as place from r where nth = 1 and len(ws) >= 5),
        p as (select place, ws, unnest(generate_series(1, len(ws))) as p from c),
        v as (select place, p, array_to_string(list_concat(ws[1:p - 1], ws[p + 1:]), ' ') as v from p),
        near as (select place from (select place, min(place) over (partition by p, v) as least from v) where least < place
                 union select c.place from c join (select v, min(place) as least from v group by v) x on x.v = c.k where least < c.place
                 union select v.place from v join c on c.k = v.v where c.place < v.place),
        m as (select r.doc_id, r.line, r.i, len(r.ws) > 0 and r.nth > 1 as equal, near.place is not null as near
              from r left join c on c.doc_id is not distinct from r.doc_id and c.i = r.i left join near on near.place = c.place),
        s as (select doc_id, count(*) as n_lines, count_if(equal)::bigint as n_equal, count_if(near)::bigint as n_near,
                     string_agg(line, chr(10) order by i) filter (where not equal and not near) as kept from m group by doc_id)
        select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_equal, 0) as n_equal, coalesce(n_near, 0) as n_near, sha256(coalesce(kept, '')) as kept_sha256
        from d left join s on s.doc_id is not distinct from d.doc_id
    """


def sharding(shards: int = 40, seed: int = 11) -> str:
    # DuckDB has no CRC-32: the table of the 256 bytes, then one step a byte.
    step = "case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end"
    return f"""
        with crc as (select list(list_reduce(list_prepend(i, range(8)), lambda a, b: {step}) order by i) as steps from (select unnest(range(256)) as i)),
        d as (select doc_id, source, coalesce('=' || source, '') as skey, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h from documents),
        b as (select *, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint) as bytes from d),
        u as (select doc_id, source, skey, (len(bytes) + 16)::bigint as size, md5(text) as digest, {_uniform(seed, 'doc_id', 'md5(text)')} as u,
                     xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295) as text_crc32
              from b, crc),
        r as (select *, row_number() over (partition by skey order by u, doc_id, digest) - 1 as nth, count(*) over (partition by skey) as in_source from u),
        f as (select *, (nth + {_uniform(seed + 1, 'skey')} / {1 << 60}::double) / in_source as f from r),
        p as (select *, row_number() over (order by f, skey, u, doc_id, digest) - 1 as position, count(*) over () as n from f)
        select doc_id, source, size, text_crc32, 'rows' as law, (position * {shards} // n)::integer as shard,
               position - (position * {shards} // n * n + {shards - 1}) // {shards} as slot, null::integer as grown_shard
        from p
    """


def clusters(k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64) -> str:
    most = 1 << 27
    parts = []
    for i in range(rounds + 1):
        parts.append(f"""
        d{i} as (select rid, vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from kept, c{i}),
        a{i} as (select * from d{i} qualify row_number() over (partition by rid order by d, c) = 1)""")
        if i < rounds:
            parts.append(f"""
        s{i} as (select c, i, sum(x) as s, count(*) as n from (select c, unnest(v) as x, generate_subscripts(v, 1) as i from a{i}) group by c, i),
        m{i} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as m from s{i} group by c),
        c{i + 1} as (select c{i}.c, coalesce(m{i}.m, c{i}.m) as m from c{i} left join m{i} on m{i}.c = c{i}.c)""")
    return f"""
        with fine as (select * from embeddings where len(embedding) = {dims} and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
        kept as (select row_number() over () as rid, vec_id, sha256('{seed}:' || coalesce(vec_id::varchar, 'null')) as h,
                        list_transform(embedding, lambda x: greatest(-{most}, least({most}, floor(64 * x::double)))::bigint) as v from fine),
        c0 as (select (row_number() over (order by h, v) - 1)::integer as c, v as m from (select * from kept order by h, v limit {k})), {",".join(parts)}
        select vec_id, a.c as cluster, d as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
               sha256(array_to_string(m, ',')) as centroid_sha256
        from a{rounds} a join c{rounds} f on f.c = a.c
    """


#: DuckDB has no CRC-32: the table of the 256 bytes, then one step a byte.
_CRC_TABLE = """crc as (select list(list_reduce(list_prepend(i, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) as steps
                from (select unnest(range(256)) as i))"""


def manifest(levels: int = 7, tops: int = 3) -> str:
    """Levels of a language's tree and of the tree over the languages that the SQL goes through: enough
    for 8**levels documents of a language and 8**tops languages."""

    def value(c: str) -> str:
        return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join([*map(value, ("doc_id", "source", "lang", "n_chars")), value(text)]) + ")"

    def tree(name: str, first: str, keys: str, height: int) -> list[str]:
        """name0..: g, i, h, n of the nodes of each level; name_s0..: with their siblings' digests before and after."""
        over = f"partition by {keys}, i // 8 order by i"
        out = [f"{name}0 as ({first})"]
        for x in range(height):
            out.append(f"""{name}_s{x} as (select *, coalesce(string_agg(h, '') over ({over} rows between unbounded preceding and 1 preceding), '') as before,
                     coalesce(string_agg(h, '') over ({over} rows between 1 following and unbounded following), '') as after from {name}{x})""")
            out.append(f"""{name}{x + 1} as (select g, i // 8 as i, case when n > 1 then sha256(string_agg(h, '' order by i)) else min(h) end as h, (n + 7) // 8 as n
                     from {name}{x} group by g, i // 8, n)""")
        return out

    docs = tree("l", "select lang as g, i, leaf as h, n from d", "g", levels)
    langs = tree("t", f"select 0 as g, row_number() over (order by g nulls first) - 1 as i, h, count(*) over () as n, g as lang from l{levels}", "g", tops)
    joins, near = [], []
    for x in range(levels):
        joins.append(f"join l_s{x} on l_s{x}.g is not distinct from d.lang and l_s{x}.i = d.i // {8**x}")
        near.append(f"case when l_s{x}.n > 1 then l_s{x}.before || l_s{x}.after else '' end")
    joins.append("join t0 on t0.lang is not distinct from d.lang")
    for x in range(tops):
        joins.append(f"join t_s{x} on t_s{x}.i = t0.i // {8**x}")
        near.append(f"case when t_s{x}.n > 1 then t_s{x}.before || t_s{x}.after else '' end")
    # One column a level, each from the one before.
    columns = [f"(case when a{x}_n > 1 then sha256(a{x}_b || f{x} || a{x}_a) else f{x} end) as f{x + 1}" for x in range(levels + tops)]
    sources = [f"l_s{x}" for x in range(levels)] + [f"t_s{x}" for x in range(tops)]
    wide = ", ".join(f"{s}.n as a{x}_n, {s}.before as a{x}_b, {s}.after as a{x}_a" for x, s in enumerate(sources))
    chain = "w"
    for c in columns:
        chain = f"(select *, {c} from {chain})"
    return f"""
        with {_CRC_TABLE},
        k as (select *, {leaf('text')} as leaf, {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} as changed, list_transform(range(length(hex(encode(doc_id::varchar))) // 2),
                     lambda j: ('0x' || substr(hex(encode(doc_id::varchar)), 2 * j + 1, 2))::bigint) as bytes from documents),
        c as (select k.*, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295) % 3 = 0 as tampered from k, crc),
        d as (select doc_id, lang, leaf, case when tampered then changed else leaf end as seen, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i,
                     count(*) over (partition by lang) as n from c), {", ".join(docs)}, {", ".join(langs)},
        w as (select d.doc_id, d.leaf, t0.h as subroot, d.seen as f0, sha256({" || ".join(near)}) as proof_sha256, {wide} from d {" ".join(joins)})
        select doc_id, leaf, subroot, r.h as root, proof_sha256, f{len(columns)} as folded_root, f{len(columns)} = r.h as verified from {chain}, (select h from t{tops}) r
    """


ORACLES: dict[str, str] = {
    "op4_line_dedup": lines(),
    "op5_mix_sources": mixing(),
    "op6_warc_revisits": warc(),
    "op7_quality_rules": quality(),
    "op8_interleave_shards": sharding(),
    "op10_substring_dedup": substring(),
    "op11_centroid_clusters": clusters(),
    "op12_merkle_manifest": manifest(),
}

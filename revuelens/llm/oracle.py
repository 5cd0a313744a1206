"""SQL of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x20\x09-\x0D]+"


def mix_sources(seed: int, epochs: int = 3) -> str:
    """The water level is that of the first source, by cap per weight, that stays below its cap."""
    return f"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) as size,
        cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || '#' || md5(coalesce(text, '')) || '#{seed}#mix'), 1, 3) as bigint) as bucket
        from documents),
    s as (select source, cast(sum(size) as bigint) as ss,
        (row_number() over (order by source asc nulls last) - 1) % 3 + 1 as weight from d group by source),
    o as (select *, {epochs} * ss as cap, row_number() over (order by {epochs} * ss / cast(weight as double), source) as k from s),
    l as (select *, (sum(ss) over () - coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0))
        / cast(sum(weight) over (order by k rows between current row and unbounded following) as double) as level from o),
    v as (select level from l where cap >= weight * level order by k limit 1),
    t as (select source, ss, least(cast(cap as double), weight * coalesce((select level from v), 1e300)) as target from l),
    w as (select *, case when ss > 0 then cast(floor(target / ss) as int) else 0 end as whole from t),
    b as (select source, bucket, size, coalesce(sum(size) over (partition by source order by bucket
        rows between unbounded preceding and 1 preceding), 0) as before
        from (select source, bucket, sum(size) as size from d group by 1, 2)),
    c as (select w.*, coalesce((select max(bucket + 1) from b where b.source is not distinct from w.source
        and w.whole < {epochs} and w.target - w.whole * w.ss > 0
        and b.before + b.size / cast(2 as double) <= w.target - w.whole * w.ss), 0) as cut from w)
    select doc_id, cast(size as bigint) as size, ss as source_size, target,
        cast((whole + cast(bucket < cut as int)) * size as bigint) as taken, cast(whole + cast(bucket < cut as int) as int) as repeats
    from d join c on d.source is not distinct from c.source"""


def _components(vertices: str) -> str:
    """Smallest id reachable over ``links(a, b)``, as ``low``."""
    return f"""both_ways as (select a, b from links union select b, a from links),
    reach as (select id, id as other from {vertices} union select r.id, e.b from reach r join both_ways e on e.a = r.other),
    low as (select id, min(other) as low from reach group by 1)"""


def near_duplicates(length: int, percent: int) -> str:
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(length))
    return f"""with recursive d as (select doc_id as id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') as w from documents),
    g as (select distinct id, unnest(case when len(w) >= {length} then list_transform(range(1, len(w) - {length} + 2), lambda i: {gram})
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as gram from d),
    n as (select id, count(*) as n from g group by 1),
    links as (select p.a, p.b from (select x.id as a, y.id as b, count(*) as k from g x join g y on x.gram = y.gram and x.id < y.id
        group by 1, 2) p join n na on na.id = p.a join n nb on nb.id = p.b where 100 * k >= {percent} * (na.n + nb.n - k)),
    {_components("d")}
    select d.id as doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, low.low as component_id, d.id = low.low as kept
    from d join low using (id) left join n using (id)"""


def nearest_embeddings(threshold: float) -> str:
    return f"""with recursive e as (select vec_id as id, label, cast(embedding as double[]) as v from embeddings),
    ok as (select * from e where label is not null and v is not null and len(v) > 0
        and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
    links as (select x.id as a, y.id as b from ok x join ok y on x.label = y.label and x.id < y.id
        where list_cosine_similarity(x.v, y.v) >= {threshold}),
    {_components("e")},
    n as (select a as id, count(*) as n from both_ways group by 1)
    select e.id as vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, low.low as component_id, e.id = low.low as kept
    from e join low using (id) left join n using (id)"""


# The 256 remainders of the reversed crc32 polynomial.
CRC_TABLE = """crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) as remainders)"""


def crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of an expression, beside ``crc``."""
    byte = f"cast('0x' || substr(hex(encode({text})), 2 * i + 1, 2) as bigint)"
    bytes_of = f"list_transform(range(octet_length(encode({text}))), lambda i: {byte})"
    step = "xor(c >> 8, remainders[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {bytes_of}), lambda c, b: {step}), 4294967295)"


def merkle_manifest(fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> str:
    def leaf(changed: str | None = None) -> str:
        read = [changed if changed and f == "text" else f"cast({f} as varchar)" for f in fields]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({r})) || ':' || {r}, '-')" for r in read) + ")"

    tampered = f"case when {crc32('cast(doc_id as varchar)')} % 2 = 0 then replace(text, chr(10), '') else text end"

    def levels(name: str, start: str) -> str:
        return f"""{name} as ({start} union all select tree, level + 1, spot // 3, (size + 2) // 3, sha256(string_agg(node, '' order by spot))
        from {name} where size > 1 group by tree, level, spot // 3, size),
    {name}_steps as (select n.tree, n.level, n.spot, coalesce(string_agg(m.node, '' order by m.spot) filter (m.spot < n.spot), '') as l,
        coalesce(string_agg(m.node, '' order by m.spot) filter (m.spot > n.spot), '') as r
        from {name} n join {name} m on n.tree = m.tree and n.level = m.level and n.spot // 3 = m.spot // 3 where n.size > 1 group by all)"""

    def walk(name: str, start: str, steps: str) -> str:
        return f"""{name} as ({start} union all select w.doc, w.tree, w.level + 1, w.spot // 3, sha256(s.l || w.node || s.r), w.proof || s.l || s.r
        from {name} w join {steps} s on s.tree = w.tree and s.level = w.level and s.spot = w.spot),
    {name}_end as (select * from {name} qualify row_number() over (partition by doc order by level desc) = 1)"""

    return f"""with recursive {CRC_TABLE},
    read as (select row_number() over () as doc, doc_id, {leaf()} as leaf, {leaf("changed")} as changed_leaf,
        dense_rank() over (order by source asc nulls first) as tree
        from (select d.*, {tampered} as changed from documents d, crc)),
    leaves as (select *, row_number() over (partition by tree order by doc_id asc nulls first, leaf) - 1 as spot,
        count(*) over (partition by tree) as size from read),
    {levels("inner_nodes", "select tree, 0 as level, spot, size, leaf as node from leaves")},
    tops as (select tree, node from inner_nodes where size = 1),
    {levels("outer_nodes", "select 0 as tree, 0 as level, tree - 1 as spot, (select count(*) from tops) as size, node from tops")},
    {walk("climb", "select doc, tree, 0 as level, spot, changed_leaf as node, '' as proof from leaves", "inner_nodes_steps")},
    {walk("reach", "select doc, 0 as tree, 0 as level, tree - 1 as spot, node, proof from climb_end", "outer_nodes_steps")},
    root as (select node from outer_nodes where size = 1)
    select l.doc_id, l.leaf, t.node as subroot, root.node as root, sha256(e.proof) as proof_sha256, e.node as folded_root,
        e.node = root.node as verified
    from leaves l join tops t on t.tree = l.tree join reach_end e on e.doc = l.doc, root"""


def spelling_variants(letters: str = "A-Za-zÀ-ÿ", every: int = 199) -> str:
    """Words of equal length are near if they agree without one place, others if leaving one out gives the shorter."""
    return f"""with recursive {CRC_TABLE},
    runs as (select id, run, count(*) as k from (select coalesce(cast(doc_id as varchar), 'null') as id,
        unnest(list_transform(regexp_extract_all(text, '[{letters}]+'), lambda r: translate(r, '{UPPER}', '{LOWER}'))) as run
        from documents) group by 1, 2),
    marked as (select run, k, {crc32("id || ':' || run")} as h from runs, crc),
    spelt as (select case when h % {every} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, k
        from marked),
    words as (select word, cast(sum(k) as bigint) as n from spelt where length(word) >= 6 group by 1 having sum(k) >= 5),
    cuts as (select word, n, i, substr(word, 1, i - 1) as a, substr(word, i + 1) as z
        from (select *, unnest(range(1, length(word) + 1)) as i from words)),
    pairs as (select x.word as a, y.word as b from cuts x join cuts y on x.i = y.i and x.a = y.a and x.z = y.z and x.word <> y.word
        union select word, c.a || c.z from cuts c where c.a || c.z in (select word from words)
        union select c.a || c.z, word from cuts c where c.a || c.z in (select word from words)),
    near as (select p.a as word, count(*) as n_near, arg_min(w.word, (-w.n, w.word)) as best, max(w.n) as best_n
        from pairs p join words w on w.word = p.b group by 1),
    forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when best_n >= 5 * w.n then best end as form,
        case when best_n >= 5 * w.n then best_n end as form_n from words w left join near using (word)),
    chain as (select word, word as root, form, 0 as step from forms
        union all select c.word, f.word, f.form, step + 1 from chain c join forms f on f.word = c.form),
    ends as (select word, root from chain where form is null)
    select word, form, root, n, cast(n_near as bigint) as n_near, form_n from forms join ends using (word)"""

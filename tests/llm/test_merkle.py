import hashlib
import zlib

from pyspark.sql import functions as F

from revuelens.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, size int, up string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """Top, and for each leaf its (left, right) siblings from below."""
    paths, spots = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, spot in zip(paths, spots):
            start = spot // 3 * 3
            path.append((nodes[start:spot], nodes[spot + 1 : start + 3]))
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        spots = [s // 3 for s in spots]
    return nodes[0], paths


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, h(*map(field, r[:5]))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for members in groups.values():
        members.sort(key=lambda m: (m[0][0] is not None, m[0][0] or 0, m[1]))
    inner = {s: tree([leaf for _, leaf in groups[s]]) for s in names}
    root, outer = tree([inner[s][0] for s in names])
    out = []
    for s, above in zip(names, outer):
        for (r, leaf), path in zip(groups[s], inner[s][1]):
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = h(*map(field, (*r[:4], text)))
            for left, right in path + above:
                node = h(*left, node, *right)
            siblings = "".join("".join(a) + "".join(b) for a, b in path + above)
            out.append((r[0], leaf, inner[s][0], root, h(siblings), node, node == root))
    return sorted(out, key=str)


def manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS).repartition(3)
    found = merkle.verify_against(docs, {"text": merkle.without_line_ends()})
    columns = "doc_id", "leaf", "subroot", "root", merkle.digest(merkle.proof(F.col("steps"))), "folded_root", "verified"
    return sorted((tuple(r) for r in found.select(*columns).collect()), key=str)


def test_all_digests_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    texts = [None, "", "a\nb", "Zeile ü\n漢字🙂", "x" * 60_000 + "\n", "same"]
    rows = [(i * 7 % 211, ("hot", "b", None, "ä")[i % 4 if i % 3 else 0], "en" if i % 5 else None, i, texts[i % 6]) for i in range(211)]
    rows += [(None, "hot", None, None, "no id"), (None, None, None, None, None), (3, "hot", "en", 1, "twice"), (3, "hot", "en", 1, "twice")]
    rows += [(900, "", "en", 2, "empty name"), (901, "alone", "en", 2, "one\nline")]
    got = manifest(spark, rows)
    assert got == expected(rows)
    assert {r[-1] for r in got} == {True, False}


def test_single_document_and_empty_table(spark):
    rows = [(5, None, None, None, None)]
    got = manifest(spark, rows)
    assert got == expected(rows)
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == h("")
    assert manifest(spark, []) == []


def test_levels_share_one_exchange(spark):
    nodes = spark.range(100).selectExpr("id % 2 as k", "id div 2 as at", "50 as size", "sha2(string(id), 256) as node")
    plan = merkle.pivot_levels(nodes, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1

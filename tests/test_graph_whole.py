"""The graph queries over whole tables, with names of three letters and more, against brute force."""

import re

import pytest

from textquarry import catalog

TEXTS = ["The fox saw old\nworthless idea", "fox den\nidea fox ran", "old fox_hole ab\nden worthless", "ab cd\nzzz only here", None, "ran away\nworthless ran"]
WORD = re.compile("[A-Za-z_][A-Za-z0-9_]*")


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("graph"))
    spark.createDataFrame([(i, t, "en", "src") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    return at


@pytest.fixture(scope="module")
def symbols():
    """path, line, name, identifiers of the line."""
    out = []
    for i, t in enumerate(TEXTS):
        for n, line in enumerate((t or "").split("\n"), 1):
            if m := re.search("[A-Za-z_][A-Za-z0-9_]{2,}", line):
                out.append((f"src/en/{i}.txt", n, m[0], {w for w in WORD.findall(line) if len(w) >= 3}))
    return out


@pytest.fixture(scope="module")
def edges(symbols):
    used = {f"src/en/{i}.txt": {w for w in WORD.findall(t or "") if len(w) >= 3} for i, t in enumerate(TEXTS)}
    return {(src, dst) for src, words in used.items() for dst, _, name, _ in symbols if name in words and src != dst}


def reached(start, step, found):
    """name -> depth over step, then the symbols that found gives for each, at the smallest depth."""
    depth, level = {start: 0}, {start}
    for d in range(1, 5):
        level = {x for n in level for x in step(n)} - set(depth)
        depth.update(dict.fromkeys(level, d))
    out = {}
    for name, d in depth.items():
        for key in found(name):
            out[key] = min(out.get(key, 9), d + 1)
    return sorted((*k, d) for k, d in out.items())


def rows(spark, tree, name):
    return sorted(tuple(r) for r in catalog.queries()[name](spark, tree).collect())


def test_edges_and_degrees(spark, tree, edges):
    assert any(dst == "src/en/1.txt" for _, dst in edges)  # found by "fox" and "idea" alone
    assert rows(spark, tree, "reference_edges") == sorted(edges)
    assert rows(spark, tree, "out_degree") == sorted((s, sum(a == s for a, _ in edges)) for s in {a for a, _ in edges})


def test_reach(spark, tree, symbols):
    names = {s[2] for s in symbols}
    users = lambda n: [s for s in symbols if n in s[3] and n != s[2] and n in names]
    want = reached(catalog.USED, lambda n: {s[2] for s in users(n)}, lambda n: {(p, name, line) for p, line, name, _ in users(n)})
    assert rows(spark, tree, "impact_bfs") == want and any(d > 1 for *_, d in want)
    used = lambda n: {i for s in symbols if s[2] == n for i in s[3] if i != n and i in names}
    want = reached(catalog.USER, used, lambda n: {(p, name, line) for p, line, name, _ in symbols if name in used(n)})
    assert rows(spark, tree, "callgraph_bfs") == want and any(d > 1 for *_, d in want)


def test_ranks_and_map(spark, tree, symbols, edges):
    paths = [f"src/en/{i}.txt" for i in range(len(TEXTS))]
    deg = {p: sum(a == p for a, _ in edges) for p in paths}
    rank = dict.fromkeys(paths, 1 / len(paths))
    for _ in range(30):
        lost = sum(r for p, r in rank.items() if not deg[p]) / len(paths)
        rank = {p: 0.15 / len(paths) + 0.85 * (lost + sum(rank[a] / deg[a] for a, b in edges if b == p)) for p in paths}
    got = dict(rows(spark, tree, "pagerank"))
    assert got == pytest.approx(rank, abs=2e-8)
    shown = [r[0] for r in sorted(rows(spark, tree, "repo_map"), key=lambda r: r[2])]
    assert shown == sorted({s[0] for s in symbols}, key=lambda p: (-round(rank[p], 12), p))


def test_map_reads_symbols_of_shown_files_only(spark, tree, monkeypatch):
    """The symbols of all files are not written for a map that shows a few."""
    from textquarry.sources import corpus as co

    written = []
    monkeypatch.setattr(co, "keep", lambda spark, key, name, make, order: written.append(name) or make())
    assert rows(spark, tree, "repo_map") and written == []

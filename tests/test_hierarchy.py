import random

from facetlake.operators.hierarchy import descendants, hierarchy_table
from facetlake.plans import general

SCHEMA = "hierarchy string, scope string, node string, parent string, id string"


def expected(links):
    parent, nodes = {}, set()
    for h, s, n, p in links:
        if n is None:
            continue
        s = s or ""
        nodes.add((h, s, n))
        if p is not None:
            nodes.add((h, s, p))
            parent[(h, s, n)] = (h, s, p)
    trail, below = {}, dict.fromkeys(nodes, 0)
    for n in nodes:
        walk = [n]
        while walk[-1] in parent and parent[walk[-1]] not in walk:
            walk.append(parent[walk[-1]])
        if walk[-1] in parent:
            trail[n] = -1 if parent[walk[-1]] == n else -2
        else:
            trail[n] = walk
            for a in walk[1:]:
                below[a] += 1
    out = []
    for n, t in trail.items():
        out.append((*n, "", t, -1, "") if isinstance(t, int) else (*n, t[-1][2], len(t) - 1, below[n], "/".join(x[2] for x in reversed(t))))
    return sorted(out, key=str)


def frame(spark, links):
    return spark.createDataFrame([(*x, "own id") for x in links], SCHEMA)


def test_forest_with_loops_and_repeats(spark, rows):
    rng = random.Random(5)
    links = [("h", rng.choice(["s", "t", None]), f"n{i}", f"n{rng.randrange(i)}") for i in range(1, 40)]
    seen = {}
    links = [seen.setdefault((s or "", n), (h, s, n, p)) for h, s, n, p in links]
    links += [("h", "chain", f"c{i + 1:02d}", f"c{i:02d}") for i in range(14)]
    links += [("h", "loop", "a", "b"), ("h", "loop", "b", "c"), ("h", "loop", "c", "a"), ("h", "loop", "d", "a"), ("h", "loop", "e", "d"), ("h", "self", "x", "x"), ("h", "self", "y", "x")]
    links += [("g", "s", "lonely", None), ("g", "s", None, "z"), *links[:9]]
    for peels in (3, 1):
        got = hierarchy_table(frame(spark, links), peels)
        assert rows(got, "hierarchy", "scope", "node", "root", "depth", "n_descendants", "path") == expected(links)


def test_descendants_and_empty(spark, rows):
    links = [("h", "s", "b", "a"), ("h", "s", "c", "b"), ("h", "s", "q", "q")]
    assert rows(descendants(frame(spark, links)), "ancestor", "descendant", "distance") == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
    assert hierarchy_table(frame(spark, [])).count() == 0


def test_concepts_without_a_scheme_find_their_parents(spark, rows, tmp_path):
    concept = "scheme string, local_name string, class_uri string, concept_iri string, parent_uri string"
    data = {
        "imported_relationship": ([], "graph_name string, to_uid string, from_uid string, relationship_type string, code_space string"),
        "relationship_type": ([], "local_name string, code_space string, category string"),
        "local_minimal_example": ([(None, "top", "u:top", None, None), (None, "low", "u:low", None, "u:top"), ("", "least", None, None, "low"), ("s", "other", None, None, "u:top")], concept),
    }
    for name, (given, schema) in data.items():
        spark.createDataFrame(given, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert rows(general.p2_found(spark, str(tmp_path)), "scope", "node", "root") == [("", "least", "top"), ("", "low", "top"), ("", "top", "top"), ("s", "other", "other")]
    assert rows(general.p2_descendants(spark, str(tmp_path)), "ancestor", "descendant") == [("low", "least"), ("top", "least"), ("top", "low")]

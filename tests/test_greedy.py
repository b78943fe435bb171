import random

from quillgraph.operators import graph


def truth(edges, seeds, widths, least=3.0):
    by: dict = {}
    for src, dst, pos, score, cited in sorted(edges, key=lambda e: (e[0], e[2])):
        by.setdefault(src, {}).setdefault(dst, (score, pos, cited))
    out = []
    for seed in seeds:
        seen, front = {seed}, [(seed, [seed])]
        for depth, width in enumerate(widths, 1):
            new = []
            for parent, path in front:
                fresh = [(d, *e) for d, e in by.get(parent, {}).items() if d not in seen]
                best = [(-s, p, d) for d, s, p, _ in fresh if s >= least] or [(-min(c / 100, 50.0), p, d) for d, _, p, c in fresh]
                for s, _, d in sorted(best)[:width]:
                    seen.add(d)
                    new.append((d, [*path, d]))
                    out.append((seed, depth, len(new), parent, d, -s, ">".join([*path, d])))
            front = new
    return sorted(out)


def test_equals_the_sequential_choice(spark):
    rng = random.Random(3)
    for widths in ((3, 2), (10, 7), (2,), (2, 2, 2)):
        edges = [(f"n{rng.randrange(40)}", f"n{int(rng.paretovariate(0.7)) % 60}", i, rng.choice((0.5, 2.5, 3.0, 7.0, 9.0)), float(rng.choice((0, 40, 900, 9000)))) for i in range(900)]
        edges += [("hub", f"n{i % 60}", 2000 + i, float(i % 5), 10.0) for i in range(400)]
        seeds = ["n1", "n2", "hub", "none", "n39"]
        out = graph.expand_greedily(spark.createDataFrame(edges, "src string, dst string, pos int, score double, cited double"), spark.createDataFrame([(s,) for s in seeds], "seed string"), widths)
        got = sorted((r.seed, r.depth, r["rank"], r.parent, r.node, r.score, ">".join(r.path)) for r in out.collect())
        assert got == truth(edges, seeds, widths)


def test_no_rows(spark):
    e = spark.createDataFrame([], "src string, dst string, pos int, score double, cited double")
    assert graph.expand_greedily(e, spark.createDataFrame([("a",)], "seed string")).count() == 0
    assert graph.expand_greedily(e, spark.createDataFrame([], "seed string")).count() == 0


def test_rows_meet_once_for_each_depth(spark):
    """Edges move once, and for each depth its parents twice, as they are dealt to their candidates and back; seeds may repeat or be null."""
    from test_papers import shuffled

    rng = random.Random(8)
    edges = sorted({(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}", i, rng.choice((1.0, 4.0, 9.0)), 10.0) for i in range(2000)})
    seeds = [f"n{i}" for i in range(90)]
    made = spark.createDataFrame(edges, "src string, dst string, pos int, score double, cited double"), spark.createDataFrame([(s,) for s in [*seeds, "n7", "n7", None]], "seed string")
    before = shuffled(spark)
    got = sorted((r.seed, r.depth, r["rank"], r.parent, r.node, r.score, ">".join(r.path)) for r in graph.expand_greedily(*made, (3, 2)).collect())
    moved = sum(v for k, v in shuffled(spark).items() if k not in before)
    assert got == truth(edges, [*seeds, "n7", "n7"], (3, 2))
    parents = len(seeds) + len({x[:5] for x in truth(edges, seeds, (3, 2)) if x[1] == 1})
    assert moved <= len(edges) + 2 * parents + len(seeds) + 2 + spark.sparkContext.defaultParallelism

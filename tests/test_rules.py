"""Many ignore rules at once, against one rule after the other."""

import random
import re

from pyspark.sql import functions as F

from siltstone.sources import files


def test_automata_equal_rule_by_rule(spark):
    rng = random.Random(4)
    part = lambda: rng.choice(["src", "lib", "a", "b.c", "x+y", "é", "deep", "node"])
    shape = lambda: rng.choice([part(), f"/{part()}/", f"*.{rng.choice('abc')}", f"**/{part()}", f"{part()}/**/{part()}", f"{part()}/*", f"[a-c]{part()}", f"{part()}?"])
    rules = files.compile_rules([("!" if rng.random() < 0.3 else "") + shape() for _ in range(900)])
    paths = ["/".join(part() + rng.choice(["", ".a", ".b", "1"]) for _ in range(rng.randint(1, 4))) for _ in range(400)] + ["", None]

    def slowly(path, rules):
        fits = [r for r in rules if path is not None and re.search(r.regex, path)]
        return bool(fits) and not fits[-1].negated

    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    for some in (rules, rules[: files.FEW_RULES + 1], rules[:5]):
        got = rows.select("p", files.ignored(F.col("p"), some).alias("i"), files.forced(F.col("p"), some).alias("f")).collect()
        for r in got:
            if r.p is not None:
                assert r.i == slowly(r.p, some), r.p
                assert r.f == any(re.search(x.regex, r.p) for x in some if x.negated), r.p

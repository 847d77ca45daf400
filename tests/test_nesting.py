"""Classes around units by one ordered pass, against filters over all classes."""

import random
import time

from pyspark.sql import functions as F

from unitloom.operators.joins import innermost_enclosing


def test_innermost_class_equals_a_filter_over_all_classes(spark):
    rnd = random.Random(7)
    classes, units = [], []
    for f in range(40):
        path = None if f == 0 else f"f{f}.py"
        for n in range(rnd.randrange(12)):
            start = rnd.randrange(1, 30)
            classes.append((path, start, start + rnd.randrange(15), f"C{n}"))
        for n in range(rnd.randrange(12)):
            start = rnd.randrange(1, 32)
            units.append((path, f"u{n}", start, start + rnd.randrange(8)))
    classes += [("f1.py", None, 5, "X"), ("f1.py", 1, None, "Y"), classes[-1]]
    units += [("f1.py", "no start", None, 3), ("f1.py", "no end", 3, None), ("alone.py", "u", 1, 2), units[-1]]
    c = spark.createDataFrame(classes, "path string, start_line int, end_line int, name string")
    u = spark.createDataFrame(units, "path string, unit string, start_line int, end_line int")

    def innermost(path, start, end):
        if None in (path, start, end):
            return None
        around = [(s, e, n) for p, s, e, n in classes if p == path and None not in (s, e) and s <= start and end <= e]
        return max(around)[1:] if around else None

    got = [(r.path, r.unit, r.start_line, r.end_line, r.enclosing and tuple(r.enclosing)) for r in innermost_enclosing(u, c).collect()]
    want = [(p, n, s, e, innermost(p, s, e)) for p, n, s, e in units]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert innermost_enclosing(u.limit(0), c).collect() == [] and innermost_enclosing(u, c.limit(0)).filter("enclosing is not null").count() == 0


def test_a_file_of_many_classes_costs_what_its_rows_cost(spark):
    def seconds(n):
        c = spark.range(n).selectExpr("'big.py' path", "cast(3 * id + 1 as int) start_line", "cast(3 * id + 3 as int) end_line", "concat('C', id) name")
        u = spark.range(n).selectExpr("'big.py' path", "cast(3 * id + 2 as int) start_line", "cast(3 * id + 3 as int) end_line")
        start = time.time()
        row = innermost_enclosing(u, c).agg(F.count("enclosing").alias("n"), F.max("enclosing.name").alias("last")).first()
        assert row.n == n
        return time.time() - start

    seconds(1000)
    assert seconds(80_000) < 6 * seconds(20_000) + 2

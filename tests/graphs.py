"""Small graphs with known answers, as ``src-dst`` or ``src-dst:value[,value]`` words."""

from arcspark.sources.builders import static_graph

HEXAGON = "0-1:7 0-2:9 0-5:14 1-0:7 1-2:10 1-3:15 2-0:9 2-1:10 2-3:12 2-5:2 3-1:15 3-2:12 3-4:6 4-3:6 4-5:9 5-0:14 5-2:2 5-4:9"


def graph(spark, n, words, names=("w",)):
    rows = []
    for word in words.split():
        ends, _, values = word.partition(":")
        rows.append((*map(int, ends.split("-")), *(int(x) for x in values.split(",") if x)))
    wide = max((len(r) for r in rows), default=2)
    columns = ["src", "dst", *names][:wide]
    return static_graph(n, spark.createDataFrame(rows, ", ".join(f"{c} long" for c in columns)))


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())

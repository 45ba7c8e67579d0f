"""DOT text of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcspark.graph import Graph


def escaped(text: Column) -> Column:
    """Backslashes and double quotes with a backslash before them."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"')


def _attribute(df: DataFrame, column: str, name: str) -> Column:
    """`` name="value"`` where the column exists and isn't null, else nothing."""
    if column not in df.columns:
        return F.lit(None).cast("string")
    value = F.col(column)
    kind = dict(df.dtypes)[column]
    if kind.startswith("struct"):
        joined = F.concat_ws("," if name == "pos" else " ", *(value[f].cast("string") for f in df.schema[column].dataType.names))
        text = F.concat(joined, F.lit("!")) if name == "pos" else joined
    else:
        text = escaped(value.cast("string"))
    return F.when(value.isNotNull(), F.concat(F.lit(f'{name}="'), text, F.lit('"')))


def dot_lines(graph: Graph, page: tuple[float, float] | None = None) -> DataFrame:
    """``section, pos, line`` in file order by (section, pos): header, vertices, arcs, end.

    Vertex columns ``label, pos, size, color`` and arc columns ``label, size, color`` are used
    where they exist; a size is the width of a vertex and the pen width of an arc.
    """
    spark = graph.spark
    v, a = graph.vertices, graph.arcs

    def line(df: DataFrame, head: Column, names: dict[str, str]) -> Column:
        attributes = F.concat_ws(", ", *(_attribute(df, c, n) for c, n in names.items()))
        return F.concat(F.lit("  "), head, F.when(attributes != "", F.concat(F.lit(" ["), attributes, F.lit("]"))).otherwise(""), F.lit(";"))

    vertices = v.select(F.lit(1).alias("section"), F.col("id").alias("pos"), line(v, F.col("id").cast("string"), {"label": "label", "pos": "pos", "size": "width", "color": "color"}).alias("line"))
    between = F.concat_ws(" -> ", F.col("src").cast("string"), F.col("dst").cast("string"))
    arcs = a.select(F.lit(2).alias("section"), F.col("arc_id").alias("pos"), line(a, between, {"label": "label", "size": "penwidth", "color": "color"}).alias("line"))
    head = "digraph {" + (f' size="{page[0]:g},{page[1]:g}";' if page else "")
    frame = spark.createDataFrame([(0, 0, head), (3, 0, "}")], "section int, pos long, line string")
    return frame.unionAll(vertices).unionAll(arcs)


def write_dot(graph: Graph, path: str, page: tuple[float, float] | None = None) -> None:
    """Write the lines as text, in order over the part files."""
    dot_lines(graph, page).orderBy("section", "pos").select("line").write.text(path)

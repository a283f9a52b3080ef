"""Dependency graph: extraction, degrees, neighbourhoods, traversal, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.store import materialize

#: Import and export patterns; the target is the named group's number.
IMPORTS = [
    (r"import\s+\{([^}]+)\}\s+from\s+['\"]([^'\"]+)['\"]", 2),
    (r"import\s+type\s+\{([^}]+)\}\s+from\s+['\"]([^'\"]+)['\"]", 2),
    (r"import\s+(\w+)\s+from\s+['\"]([^'\"]+)['\"]", 2),
    (r"import\s+type\s+(\w+)\s+from\s+['\"]([^'\"]+)['\"]", 2),
    (r"import\s+\*\s+as\s+(\w+)\s+from\s+['\"]([^'\"]+)['\"]", 2),
    (r"import\s+['\"]([^'\"]+)['\"]", 1),
    (r"export\s+\{([^}]+)\}\s+from\s+['\"]([^'\"]+)['\"]", 2),
    (r"export\s+type\s+\{([^}]+)\}\s+from\s+['\"]([^'\"]+)['\"]", 2),
    (r"export\s+\*\s+from\s+['\"]([^'\"]+)['\"]", 1),
    (r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", 1),
]
EXPORTS = [(r"export\s+\{([^}]+)\}", 1), (r"export\s+(?:default\s+)?(?:function|class|const|let|var|type|interface|enum)\s+(\w+)", 1)]


def _matches(i: int, pattern: str, group: int) -> F.Column:
    def edge(target: F.Column, names: F.Column) -> F.Column:
        symbols = F.filter(F.transform(F.split(names, ","), lambda x: F.regexp_extract(x, r"^\s*([\w$]+)", 1)), lambda x: x != "")
        return F.struct(F.lit(i).alias("rule"), target.alias("target"), (symbols if group == 2 else F.array().cast("array<string>")).alias("symbols"))

    return F.zip_with(F.regexp_extract_all("content", F.lit(pattern), F.lit(group)), F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), edge)


def imports(files: DataFrame) -> DataFrame:
    """(path, target, symbols): relative imports, one edge per target (first pattern wins)."""
    found = F.concat(*[_matches(i, p, g) for i, (p, g) in enumerate(IMPORTS)])
    x = files.select("path", F.posexplode(found).alias("pos", "f")).select("path", "pos", "f.*").where(F.col("target").startswith("."))
    return x.groupBy("path", "target").agg(F.min_by("symbols", F.struct("rule", "pos")).alias("symbols"))


def exports(files: DataFrame) -> DataFrame:
    named = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(EXPORTS[0][0]), F.lit(1)), lambda s: F.transform(F.split(s, ","), lambda x: F.regexp_extract(x, r"^\s*([\w$]+)", 1))))
    declared = F.regexp_extract_all("content", F.lit(EXPORTS[1][0]), F.lit(1))
    default = F.when(F.col("content").rlike(r"export\s+default\s+"), F.array(F.lit("default"))).otherwise(F.array().cast("array<string>"))
    return files.select("path", F.array_distinct(F.filter(F.concat(named, declared, default), lambda x: x != "")).alias("exports"))


def resolve(imported: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, symbols): the first candidate path that exists; script suffixes are dropped first."""
    folder = F.regexp_replace("path", "[^/]*$", "")
    raw = F.concat(folder, F.regexp_replace("target", r"\.(js|ts|tsx|jsx)$", ""))
    for _ in range(8):  # a/../b and ./ fall away
        raw = F.regexp_replace(F.regexp_replace(raw, r"(^|/)\./", "$1"), r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    tails = F.array(*[F.lit(x) for x in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")])
    c = imported.select(F.col("path").alias("src"), "symbols", raw.alias("raw"), F.posexplode(tails).alias("ord", "tail")).withColumn("dst", F.concat("raw", "tail"))
    ok = c.join(files.select(F.col("path").alias("dst")), "dst")
    return ok.groupBy("src", "raw").agg(F.min_by("dst", "ord").alias("dst"), F.first("symbols").alias("symbols")).select("src", "dst", "symbols")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, n_out, n_in (distinct ends), instability = out / (in + out)."""
    out = edges.select("src", "dst").distinct().groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    in_ = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    d = nodes.join(out, "node", "left").join(in_, "node", "left").na.fill(0, ["n_out", "n_in"])
    return d.withColumn("instability", F.when(F.col("n_in") + F.col("n_out") > 0, F.col("n_out") / (F.col("n_in") + F.col("n_out"))).otherwise(0.0))


def classify(deg: DataFrame) -> DataFrame:
    return deg.withColumn("role", F.when((F.col("n_in") == 0) & (F.col("n_out") == 0), "orphan").when(F.col("n_in") == 0, "entry").otherwise("inner"))


def hot(deg: DataFrame, k: int = 10) -> DataFrame:
    return deg.where("n_in > 0").orderBy(F.desc("n_in"), "node").limit(k)


def focus(nodes: DataFrame, edges: DataFrame, pattern: str) -> DataFrame:
    """Nodes whose name holds the pattern, with what they import and what imports them."""
    m = nodes.where(F.lower("node").contains(pattern.lower()))
    out = edges.join(m, edges["src"] == m["node"], "left_semi").select(F.col("dst").alias("node"))
    in_ = edges.join(m, edges["dst"] == m["node"], "left_semi").select(F.col("src").alias("node"))
    return m.select("node").union(out).union(in_).distinct()


def reach(edges: DataFrame, start: DataFrame, depth: int = 50) -> DataFrame:
    """(node, depth) by breadth-first search; each frontier is a written table, so lineage does not grow."""
    seen = materialize(start.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        nxt = edges.join(front, edges["src"] == front["node"], "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d))
        front = materialize(nxt)
        if not front.limit(1).count():
            break
        seen = seen.unionAll(front)
    return seen


def trim(edges: DataFrame) -> DataFrame:
    """Edges between nodes with a way in and a way out, until none other is left."""
    left, n = edges, -1
    while True:
        ins, outs = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        new = materialize(left.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"))
        m = new.count()
        if m == n or not m:
            return new
        left, n = new, m


def in_cycle(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle: strongly connected components by forward and backward colouring. The largest node that reaches
    a node colours it; of the nodes of one colour, those that reach the node it is named after are its component."""
    found, left = edges.select(F.col("src").alias("node")).limit(0), trim(edges.select("src", "dst").distinct())
    while left.limit(1).count():
        color = materialize(left.select(F.col("src").alias("node")).distinct().withColumn("color", F.col("node")))
        while True:
            into = left.join(color, left["src"] == color["node"]).groupBy("dst").agg(F.max("color").alias("into"))
            new = materialize(color.join(into, color["node"] == into["dst"], "left").select("node", F.greatest("color", F.coalesce("into", "color")).alias("color"), F.col("color").alias("old")))
            color = new.select("node", "color")
            if not new.where("color <> old").limit(1).count():
                break
        ends = left.join(color.toDF("src", "a"), "src").join(color.toDF("dst", "b"), "dst")
        same = materialize(ends.where("a = b").select("src", "dst", "a"))
        seen = front = materialize(color.where("node = color").select("node"))
        while front.limit(1).count():
            back = same.join(front.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
            front = materialize(back.join(seen, "node", "left_anti"))
            seen = materialize(seen.unionAll(front))
        sizes = color.join(seen, "node", "left_semi").groupBy("color").agg(F.count("*").alias("n"))
        loops = same.where("src = dst").select(F.col("src").alias("node")).distinct()
        many = color.join(seen, "node", "left_semi").join(sizes.where("n > 1"), "color", "left_semi").select("node")
        found = materialize(found.unionAll(many).unionAll(loops.join(seen, "node", "left_semi")).distinct())
        rest = left.join(seen.withColumnRenamed("node", "src"), "src", "left_anti").join(seen.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = trim(rest.select("src", "dst"))
    return found


def churn(log: DataFrame) -> DataFrame:
    return log.groupBy("file").agg(F.countDistinct("hash").alias("churn"))


def inheritance_depth(parents: DataFrame, limit: int = 50) -> DataFrame:
    """(child, depth): length of the chain of parents, cut at a repeat or the limit."""
    cur = parents.select("child", F.col("parent").alias("at"), F.array("child").alias("seen"))
    out = []
    for d in range(1, limit + 1):
        cur = materialize(cur)
        if not cur.limit(1).count():
            break
        out.append(cur.select("child", F.lit(d).alias("depth")))
        step = parents.select(F.col("child").alias("at"), "parent")
        cur = cur.join(step, "at").where(~F.array_contains("seen", F.col("parent"))).select("child", F.col("parent").alias("at"), F.concat("seen", F.array(F.col("at"))).alias("seen"))
    if not out:
        return parents.select("child", F.lit(0).alias("depth")).limit(0)
    every = out[0]
    for x in out[1:]:
        every = every.unionAll(x)
    return every.groupBy("child").agg(F.max("depth").alias("depth"))


def top_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")

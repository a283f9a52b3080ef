"""Facts of a project's files (path, content): stack, entry points, modules, the files of a change, a guide."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Extensions of a module, folders that hold none.
MODULE, NO_MODULES = r"\.(ts|tsx|js|jsx)$", r"(^|/)(node_modules|dist|\.git|coverage)/"
#: Tags of a stack by extension.
STACK = [("typescript", ["ts", "tsx", "js", "jsx"]), ("react", ["tsx", "jsx"]), ("dotnet", ["cs"]), ("sql", ["sql"])]
#: Names of libraries by dependency.
LIBRARIES = [("typescript", "TypeScript"), ("vitest", "Vitest"), ("@biomejs/biome", "Biome"), ("eslint", "ESLint"), ("prettier", "Prettier"), ("react", "React"), ("next", "Next.js"), ("express", "Express"), ("commander", "Commander.js CLI"), ("better-sqlite3", "SQLite (better-sqlite3)"), ("zod", "Zod validation")]
#: Files that are entry points, with what they are.
ENTRIES = [("src/index.ts", "Library API"), ("src/cli/index.ts", "CLI entry point"), ("src/daemon/index.ts", "Daemon process"), ("src/mcp/index.ts", "MCP server"), ("src/main.ts", "Main entry"), ("src/app.ts", "App entry"), ("src/server.ts", "Server entry"), ("index.ts", "Root entry"), ("index.js", "Root entry")]
#: Scripts that a guide names.
SCRIPTS = ["build", "dev", "test", "lint", "typecheck", "start"]


def stack_tags(files: DataFrame) -> DataFrame:
    """(tags): one row; no file, no tag. A root manifest that names react makes a react project."""
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    react = (F.col("path") == "package.json") & F.col("content").contains('"react"')
    seen = files.agg(*[F.coalesce(F.max(ext.isin(exts) | (react if tag == "react" else F.lit(False))), F.lit(False)).alias(tag) for tag, exts in STACK])
    return seen.select(F.filter(F.array(*[F.when(F.col(tag), tag) for tag, _ in STACK]), lambda x: x.isNotNull()).alias("tags"))


def manifest(files: DataFrame) -> DataFrame:
    """(name, scripts, dependencies) of the root manifest, a single row; nulls where it is absent or does not parse."""
    kind = "name string, scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>"
    one = files.where("path = 'package.json'").agg(F.from_json(F.max("content"), kind).alias("m"))
    named = lambda c: F.coalesce(F.map_keys(F.map_filter(c, lambda _, v: v != "")), F.array().cast("array<string>"))
    return one.select("m.name", "m.scripts", F.array_union(named("m.dependencies"), named("m.devDependencies")).alias("dependencies"))


def libraries(files: DataFrame) -> DataFrame:
    """(libraries): names of the known libraries that the root manifest asks for, in the table's order."""
    names = F.array(*[F.when(F.array_contains("dependencies", k), v) for k, v in LIBRARIES])
    return manifest(files).select(F.filter(names, lambda x: x.isNotNull()).alias("libraries"))


def entry_points(files: DataFrame) -> DataFrame:
    """(path, description, pos) of the well-known files that exist."""
    table = files.sparkSession.createDataFrame([(p, d, i) for i, (p, d) in enumerate(ENTRIES)], "path string, description string, pos int")
    wanted = files.where(F.col("path").isin([p for p, _ in ENTRIES])).select("path").distinct()
    return table.join(wanted, "path", "left_semi")


def modules(files: DataFrame) -> DataFrame:
    """(path, lines) of source files."""
    ok = files.where(F.col("path").rlike(MODULE) & ~F.col("path").rlike(NO_MODULES))
    return ok.select("path", F.size(F.split(F.coalesce("content", F.lit("")), "\n")).alias("lines"))


def directories(mods: DataFrame, shown: int = 8) -> DataFrame:
    """(dir, files, names): modules by their first two folders, with the first names (a bounded list by rank)."""
    parts = F.split("path", "/")
    x = mods.select(F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.get(parts, F.lit(0))).alias("dir"), "path", F.concat(F.element_at(parts, -1), F.lit(" ("), F.col("lines").cast("string"), F.lit("L)")).alias("name"))
    first = x.withColumn("_r", F.row_number().over(Window.partitionBy("dir").orderBy("path"))).where(F.col("_r") <= shown)
    names = first.groupBy("dir").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "name"))), lambda s: s["name"]), ", ").alias("names"))
    return x.groupBy("dir").agg(F.count("*").alias("files")).join(names, "dir")


def changed_files(files: DataFrame, *changed: DataFrame) -> DataFrame:
    """Files named by any of the lists of changed paths; all of them if there is no list, as without version control."""
    if not changed:
        return files
    paths = changed[0].select("path")
    for c in changed[1:]:
        paths = paths.union(c.select("path"))
    return files.join(paths.distinct(), "path", "left_semi")


def single_file(files: DataFrame, path: str, root: str = "/") -> DataFrame:
    """The file of that path, relative or below ``root``; nothing if the path leads out of it."""
    root = posixpath.normpath(root)
    full = posixpath.normpath(posixpath.join(root, path.replace("\\", "/")))
    inside = full.startswith(root.rstrip("/") + "/")
    return files.where(F.col("path") == posixpath.relpath(full, root)) if inside else files.limit(0)


def docs_stale(files: DataFrame, since: Column) -> DataFrame:
    """(stale): a source file has changed after the guide was written; a guide that never was is stale."""
    newest = F.max(F.when(F.col("path").rlike(MODULE), F.col("modificationTime")))
    return files.agg(F.coalesce(newest > since, since.isNull() & newest.isNotNull(), F.lit(False)).alias("stale"))


def guide(files: DataFrame, degrees: DataFrame | None = None, sections: list[str] | None = None) -> DataFrame:
    """(pos, section): the Markdown sections of a developer guide. Lists are short by nature: scripts, entry points, folders, five files."""
    spark = files.sparkSession
    m = manifest(files)
    head = m.select(F.lit(0).alias("pos"), F.concat(F.lit("# "), F.coalesce("name", F.lit("Project")), F.lit(" — Developer Guide")).alias("section"))
    stack = libraries(files).where(F.size("libraries") > 0).select(F.lit(1), F.concat(F.lit("**Stack**: "), F.array_join("libraries", ", ")))
    cmd = F.array(*[F.when(F.element_at("scripts", s) != "", F.concat(F.lit(f"- `npm run {s}` — `"), F.element_at("scripts", s), F.lit("`"))) for s in SCRIPTS])
    commands = m.where("scripts is not null").select(F.lit(2), F.concat(F.lit("## Commands\n\n"), F.array_join(cmd, "\n")))
    lined = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda s: s["line"]), "\n")
    at = entry_points(files).withColumn("line", F.concat(F.lit("- `"), "path", F.lit("` — "), "description"))
    entries = at.agg(lined(F.struct("pos", "line")).alias("l")).where("l <> ''").select(F.lit(3), F.concat(F.lit("## Entry Points\n\n"), "l"))
    d = directories(modules(files.where(F.col("path").startswith("src/")))).withColumn("line", F.concat(F.lit("### "), "dir", F.lit("/ ("), F.col("files").cast("string"), F.lit(" files)\n"), "names"))
    structure = d.select(F.lit(4), F.concat(F.lit("## Structure\n\n"), "line"))
    out = head.union(stack).union(commands).union(entries).union(structure)
    if degrees is not None:
        hot = degrees.where("n_in > 0").orderBy(F.desc("n_in"), "node").limit(5).withColumn("line", F.concat(F.lit("- `"), "node", F.lit("` (imported by "), F.col("n_in").cast("string"), F.lit(" modules)")))
        out = out.union(hot.agg(lined(F.struct((-F.col("n_in")).alias("o"), "node", "line")).alias("l")).select(F.lit(5), F.concat(F.lit("## Hot Dependencies\n\n"), "l")))
        alone = degrees.where("n_in = 0 AND n_out = 0").agg(F.count("*").alias("n")).where("n > 0")
        out = out.union(alone.select(F.lit(6), F.concat(F.lit("**Orphaned files**: "), F.col("n").cast("string"))))
    return out.union(spark.createDataFrame([(7 + i, s) for i, s in enumerate(sections or [])], "pos int, section string"))

"""Source files of several languages: which files count, their symbols, imports, the files these name, references, structural edges, scores.

A file is a row (path, content, language). Lines are exploded from files, candidates of an import are exploded and met by equality, so nothing is compared in pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names that say nothing about which file is meant.
GENERIC_NAMES = """
if for while switch catch return throw new typeof
await async def class import from try except with
len str int float bool dict list set tuple sum
min max abs any all map zip iter next open
print range type super isinstance issubclass getattr
setattr hasattr format join split strip replace append
extend update items keys values get pop push add
remove clear copy sort find index count read write
close send recv json parse stringify then finally
log warn error info debug trace assert expect describe
test main init run start stop build create
delete save load render use call apply bind filter
reduce forEach slice splice includes startsWith endsWith
toString valueOf Object Array String Number Boolean
Promise Error Date Math RegExp Map Set Path Exception
""".split()

# Extensions and their languages.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "tsx": "tsx", "jsx": "javascript", "go": "go", "rs": "rust", "java": "java", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp", "rb": "ruby", "php": "php", "dart": "dart"}

# Folders that no walk enters.
SKIPPED = [
    "node_modules", ".git", "__pycache__", "venv", ".venv", ".env", "dist", "build",
    ".next", "target", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox",
    "eggs", ".eggs", "site-packages",
]

# Language -> (pattern, group of the name, kind or its group, signature) of a line; the first pattern that matches decides.
SCRIPT = [
    (r"^\s*(export\s+)?(async\s+)?function\s+(\w+)\s*\(", 3, "function", "function %s()"),
    (r"^\s*(export\s+)?class\s+(\w+)", 2, "class", "class %s"),
    (r"^\s*(export\s+)?(const|let|var)\s+(\w+)\s*=\s*(async\s+)?\(?\s*(\([^)]*\))?\s*=>", 3, "function", "const %s = () =>"),
]
SYMBOLS = {
    "python": [(r"^(async\s+)?def\s+(\w+)\s*\(([^)]*)\)", 2, "function", "def %s(%s):"), (r"^class\s+(\w+)", 1, "class", "class %s:")],
    "javascript": SCRIPT,
    "typescript": SCRIPT,
    "tsx": SCRIPT,
    "go": [(r"^func\s+(?:\([^)]*\)\s+)?(\w+)\s*\(", 1, "function", "func %s()"), (r"^type\s+(\w+)\s+(struct|interface)", 1, 2, "type %s %s")],
    "dart": [
        (r"^\s*(?:abstract\s+|base\s+|final\s+|sealed\s+)?(?:class|mixin|extension)\s+(\w+)", 1, "class", "class %s"),
        (r"^\s*(?:Future<[^>]+>|Stream<[^>]+>|void|[A-Z][\w<>?]*|bool|int|double|String)\s+(\w+)\s*\(", 1, "function", "%s()"),
    ],
}
# Language -> pattern of a line that imports; Go's depends on the block a line is in.
IMPORTS = {"python": r"^(from\s+\S+\s+)?import\s+", "javascript": r"^(?:import|export\s+.*from)\s+", "typescript": r"^(?:import|export\s+.*from)\s+", "tsx": r"^(?:import|export\s+.*from)\s+", "dart": r"""^\s*(?:import|export|part)\s+['"]"""}
# What else a script's import may mean, in order.
SCRIPT_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]
# References by call, by middleware and routes, by inheritance; bases are Python's.
NAME = r"[A-Za-z_][A-Za-z0-9_]{2,}"
CALLS = rf"(?:\b|\.)({NAME})\s*\("
HOOKS = r"\b(?:preHandler|onRequest|beforeHandler|middleware|middlewares|guards|hooks)\s*[:=]\s*\[([^\]]+)\]"
ROUTES = r"\.(?:use|get|post|put|patch|delete|all|route|addHook|before)\s*\(([^)\n]{1,240})\)"
KIN = rf"\b(?:extends|implements|with)\s+({NAME})"
BASES = r"(?m)^\s*class\s+\w+\s*\(([^)]+)\)\s*:"
# Imports that say nothing about a file.
PLAIN_IMPORTS = ["json", "sys", "os", "re", "Path"]
NAMES = rf"\b({NAME})\b"
PARAMETERS = 50


def all_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def language(path: Column) -> Column:
    """A file's language by its extension; null for what is no source file."""
    ext = F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1)
    return reduce(lambda w, kv: w.when(ext == kv[0], kv[1]), LANGUAGES.items(), F.when(F.lit(False), None))


def in_folders(path: Column, folders: list[str]) -> Column:
    """Whether one of a path's folders has one of these names."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: x.isin(folders))


def lines_of(files: DataFrame) -> DataFrame:
    """(path, language, line, text, block): lines from 0; block tells the inside of a Go file's list of imports."""
    lines = files.select("path", "language", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    # only Go's files need the order of their lines
    go = lines.where("language = 'go'")
    opened = F.max(F.when(F.regexp_like(F.trim("text"), F.lit(r"^import\s*\(")), F.col("line"))).over(before)
    closed = F.max(F.when(F.startswith(F.ltrim(F.col("text")), F.lit(")")), F.col("line"))).over(before)
    go = go.withColumn("block", opened.isNotNull() & (opened > F.coalesce(closed, F.lit(-1))))
    return lines.where("language IS NULL OR language <> 'go'").withColumn("block", F.lit(False)).unionByName(go)


def symbols(files: DataFrame) -> DataFrame:
    """(path, line, kind, name, signature) of functions, classes and types."""
    text, found = F.col("text"), F.when(F.lit(False), None)
    for lang, rules in SYMBOLS.items():
        for pattern, group, kind, signature in rules:
            at = lambda g: F.regexp_extract(text, pattern, g)  # noqa: E731, B023
            more = []
            if lang == "python" and kind == "function":
                more = [F.concat(F.substring(at(3), 1, PARAMETERS), F.when(F.length(at(3)) > PARAMETERS, "...").otherwise(""))]
            elif not isinstance(kind, str):
                more = [at(kind)]
            made = F.struct((F.lit(kind) if isinstance(kind, str) else at(kind)).alias("kind"), at(group).alias("name"), F.format_string(signature, at(group), *more).alias("signature"))
            found = found.when((F.col("language") == lang) & ~F.col("block") & F.regexp_like(text, F.lit(pattern)), made)
    # a generator keeps the chain of patterns from being evaluated for each of its fields
    s = lines_of(files.where(F.col("language").isin(*SYMBOLS))).select("path", "line", "language", F.explode(F.filter(F.array(found), lambda x: x.isNotNull())).alias("s"))
    s = s.where(~((F.col("language") == "dart") & (F.col("s.kind") == "function") & F.col("s.name").isin(GENERIC_NAMES)))
    return s.select("path", "line", "s.kind", "s.name", "s.signature")


def imports(files: DataFrame) -> DataFrame:
    """(path, language, statement): the lines that import."""
    text, quoted = F.trim("text"), F.contains("text", F.lit('"'))
    hit = reduce(lambda w, kv: w.when(F.col("language") == kv[0], F.regexp_like(F.col("text"), F.lit(kv[1]))), IMPORTS.items(), F.when(F.lit(False), None))
    go = F.when(F.col("block"), ~F.startswith(text, F.lit(")")) & quoted).otherwise(F.startswith(text, F.lit("import ")) & ~F.regexp_like(text, F.lit(r"^import\s*\(")) & quoted)
    lines = lines_of(files.where(F.col("language").isin("go", *IMPORTS)))
    return lines.where(hit.when(F.col("language") == "go", go)).select("path", "language", text.alias("statement")).distinct()


def normal_path(path: Column) -> Column:
    """A path without empty parts, `.` and `..`; what leads out of the root is cut off with leading dots."""
    step = lambda done, x: F.when(x.isin("", "."), done).when((x == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(x)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda done, x: F.when(F.size(done) == 0, F.when(x.isin("", "."), done).otherwise(F.array(x))).otherwise(step(done, x)))
    return F.regexp_replace(F.array_join(parts, "/"), r"^[./]+", "")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def candidates(path: Column, lang: Column, statement: Column) -> Column:
    """What an import may name, best first: `p:` a file's path, `d:` a folder of Go files, `l:` what follows a `lib` folder."""
    none = F.array().cast("array<string>")
    keys = lambda c, kind="p:": F.transform(c, lambda x: F.concat(F.lit(kind), x))
    modules = lambda c: F.flatten(F.transform(c, lambda m: F.array(F.concat(m, F.lit(".py")), F.concat(m, F.lit("/__init__.py")))))
    # Python: relative, from, import
    dots, module = F.regexp_extract(statement, r"^from\s+(\.+)([\w.]*)\s+import\s+(.+)", 1), F.regexp_extract(statement, r"^from\s+(\.+)([\w.]*)\s+import\s+(.+)", 2)
    named = F.transform(F.split(F.regexp_extract(statement, r"^from\s+(\.+)([\w.]*)\s+import\s+(.+)", 3), ","), lambda x: F.trim(F.split(F.trim(x), " as ")[0]))
    named = F.filter(named, lambda x: (x != "") & (x != "*"))
    up = F.split(folder(path), "/")
    base = F.array_join(F.slice(up, F.lit(1), F.greatest(F.size(up) - F.length(dots) + 1, F.lit(0))), "/")
    local = F.transform(F.when(module != "", F.array(F.replace(module, F.lit("."), F.lit("/")))).otherwise(named), lambda m: normal_path(F.concat_ws("/", base, m)))
    source, whole = F.regexp_extract(statement, r"^from\s+([\w.]+)", 1), F.regexp_extract(statement, r"^import\s+([\w.]+)", 1)
    slashed = lambda m: F.replace(m, F.lit("."), F.lit("/"))
    python = F.when(dots != "", modules(local)).when(source != "", modules(F.array(slashed(source)))).when(whole != "", modules(F.array(slashed(whole), F.split(whole, r"\.")[0]))).otherwise(none)
    # scripts: only relative ones; an extension of a built file may stand for a source's
    spec = F.regexp_extract(statement, r"""(?:from|import)\s+['"]([^"']+)['"]""", 1)
    joined = normal_path(F.concat_ws("/", folder(path), spec))
    stem = F.regexp_extract(joined, r"^(.*[^/.][^/]*)\.(?:mjs|cjs|jsx|js)$", 1)
    bases = F.when(stem != "", F.array(stem, joined)).otherwise(F.array(joined))
    script = F.when(F.startswith(spec, F.lit(".")), F.flatten(F.transform(bases, lambda b: F.array(*[F.concat(b, F.lit(e)) for e in SCRIPT_ENDINGS])))).otherwise(none)
    # Go: the longest end of the package's path that is a folder
    package = F.split(F.regexp_replace(F.regexp_extract(statement, r'"([^"]+)"', 1), "^/+|/+$", ""), "/")
    go = F.transform(F.sequence(F.lit(1), F.size(package)), lambda k: F.array_join(F.slice(package, k, F.size(package)), "/"))
    # Dart: of a package its lib folder, or any; else a path from here
    quoted = F.regexp_extract(statement, r"""['"]([^"']+)['"]""", 1)
    rest = F.regexp_extract(quoted, r"^package:[^/]*/(.*)$", 1)
    dart = F.when(rest != "", F.array(F.concat(F.lit("p:lib/"), rest), F.concat(F.lit("l:"), rest))).when((quoted == "") | F.startswith(quoted, F.lit("package:")) | F.startswith(quoted, F.lit("dart:")), none).otherwise(F.array(F.concat(F.lit("p:"), normal_path(F.concat_ws("/", folder(path), quoted)))))
    return F.when(lang == "python", keys(python)).when(lang == "go", keys(go, "d:")).when(lang == "dart", dart).otherwise(keys(script))


def import_edges(files: DataFrame) -> DataFrame:
    """(src, dst): files and those they import. The best candidate that is a file counts; of a relative Python import all are meant, of a Go package its first five files."""
    i = imports(files)
    i = i.withColumn("all", (F.col("language") == "python") & F.regexp_like("statement", F.lit(r"^from\s+\.")))
    wanted = i.select(F.col("path").alias("src"), "statement", "all", F.posexplode(candidates(F.col("path"), F.col("language"), F.col("statement"))).alias("at", "key"))
    paths = files.select("path", "language").distinct()
    first = F.row_number().over(Window.partitionBy("key").orderBy("dst"))
    go = paths.where("language = 'go'").select(F.concat(F.lit("d:"), folder(F.col("path"))).alias("key"), F.col("path").alias("dst")).withColumn("n", first).where("n <= 5").drop("n")
    ends = F.split("path", "/lib/")
    ends = F.transform(F.sequence(F.lit(2), F.size(ends)), lambda k: F.concat(F.lit("l:"), F.array_join(F.slice(ends, k, F.size(ends)), "/lib/")))
    lib = paths.where(F.contains("path", F.lit("/lib/"))).select(F.explode(ends).alias("key"), F.col("path").alias("dst")).groupBy("key").agg(F.min("dst").alias("dst"))
    known = paths.select(F.concat(F.lit("p:"), "path").alias("key"), F.col("path").alias("dst")).unionByName(go).unionByName(lib)
    best = Window.partitionBy("src", "statement")
    found = wanted.join(known, "key").withColumn("best", F.min("at").over(best))
    return found.where("(all OR at = best) AND src <> dst").select("src", "dst").distinct()


def references(text: Column, lang: Column | None = None) -> Column:
    """The names that a file calls, hooks in, routes to, extends or (in Python, or where no language is given) takes as bases, without generic ones, sorted."""
    inner = lambda pattern: F.flatten(F.transform(all_of(text, pattern), lambda b: all_of(b, NAMES)))
    bases = inner(BASES) if lang is None else F.when(lang == "python", inner(BASES)).otherwise(F.array().cast("array<string>"))
    names = F.concat(all_of(text, CALLS), inner(HOOKS), inner(ROUTES), all_of(text, KIN), bases)
    return F.array_sort(F.filter(F.array_distinct(names), lambda n: ~n.isin(GENERIC_NAMES)))


def fingerprint(text: Column) -> Column:
    """What a file says of itself: its first docstring or comment of the first fifteen lines, its classes and public functions, each also as words, and what it imports."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 15), strip)
    doc = lambda x: strip(F.regexp_replace(x, "^[\"']+|[\"']+$", ""))
    quoted = lambda x: F.startswith(x, F.lit('"""')) | F.startswith(x, F.lit("'''"))
    said = F.filter(F.transform(lines, lambda x: F.when(quoted(x), F.when(doc(x) != "", F.substring(doc(x), 1, 150))).when(F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit("#!")), F.substring(strip(F.regexp_replace(x, "^[# ]+", "")), 1, 100))), lambda x: x.isNotNull())
    classes = F.transform(all_of(text, r"(?m)^class\s+(\w+)"), lambda n: F.concat_ws(" ", n, F.lower(F.regexp_replace(n, "([a-z])([A-Z])", "$1 $2"))))
    functions = F.transform(F.slice(F.filter(all_of(text, r"(?m)^(?:    )?def\s+(\w+)"), lambda n: ~F.startswith(n, F.lit("_"))), 1, 20), lambda n: F.concat_ws(" ", n, F.replace(n, F.lit("_"), F.lit(" "))))
    used = F.filter(all_of(text, r"(?m)^(?:from\s+\S+\s+)?import\s+(\w+)"), lambda n: (F.length(n) > 3) & ~n.isin(PLAIN_IMPORTS))
    return F.coalesce(F.array_join(F.concat(F.slice(said, 1, 1), classes, functions, used), " "), F.lit(""))


def structural_edges(files: DataFrame, most: int = 4) -> DataFrame:
    """(src, dst): imports, and references to symbols that at most four files define."""
    from ..operators.graph import definers

    defs = symbols(files).where((F.length("name") >= 3) & ~F.col("name").isin(GENERIC_NAMES)).select("path", "name")
    refs = files.select("path", F.explode(references(F.col("content"), F.col("language"))).alias("name"))
    return import_edges(files).unionByName(definers(defs, refs, most)).distinct()


def file_scores(files: DataFrame, ranks: DataFrame, edges: DataFrame, active: list[str], query: str, rounds: int = 6) -> DataFrame:
    """(path, score) of files for a query: rank (0.1 without one), 10 for each active file of that name, else 4 beside an active one, 5 for a name in the query, 3 for each symbol in it and 1 for each part of a symbol."""
    low, names = F.lit(query.lower()), [a.replace("\\", "/").lstrip("./") for a in active]
    paths = files.select("path").distinct()
    hits = reduce(lambda n, a: n + (F.contains("path", F.lit(a)) | F.contains(F.lit(a), F.col("path"))).cast("int"), names, F.lit(0))
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = both.where(F.col("src").isin(names)).select(F.col("dst").alias("path")).distinct().withColumn("near", F.lit(4.0))
    parts = F.concat(F.split(F.lower("name"), r"[_\s]"), F.transform(all_of(F.col("name"), "([A-Z][a-z]+)"), lambda x: F.lower(x)))
    said = F.contains(low, F.lower("name")).cast("int") * 3 + F.size(F.filter(parts, lambda x: F.contains(low, x)))
    by_symbols = symbols(files).groupBy("path").agg(F.sum(said).alias("said"))
    stem = F.lower(F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"(?<=.)\.[^.]*$", ""))
    s = paths.join(ranks.select("path", "rank"), "path", "left").join(near, "path", "left").join(by_symbols, "path", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = F.coalesce("rank", F.lit(0.1)) + hits * 10 + F.when(hits == 0, zero("near")).otherwise(0.0) + F.contains(low, stem).cast("int") * 5 + zero("said")
    return s.select("path", F.round(score, rounds).alias("score"))

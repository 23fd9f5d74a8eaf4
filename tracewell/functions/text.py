"""Column functions over prompts, texts and paths. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def prompt_words(prompt: Column, pattern: str = "[a-z][a-z0-9_-]{2,}", stop: list[str] = W.STOP_WORDS) -> Column:
    """The significant words of a prompt in order, repeats included."""
    return F.filter(F.regexp_extract_all(F.lower(prompt), F.lit(pattern), F.lit(0)), lambda w: ~w.isin(stop))


def keywords(text: Column) -> Column:
    return prompt_words(text, stop=W.INGEST_STOP_WORDS)


def index_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_]{2,}"), F.lit(0))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r".\.([^.]+)$", 1))


def is_source(path: Column) -> Column:
    return extension(path).isin(W.SOURCE_EXTENSIONS)


def path_tokens(path: Column) -> Column:
    """Parts of a path of at least two characters, and the stem if it is not among them."""
    parts = F.filter(F.split(F.lower(path), r"[/\\._-]"), lambda p: F.length(p) >= 2)
    return F.when(F.array_contains(parts, F.lower(stem(path))), parts).otherwise(F.array_append(parts, F.lower(stem(path))))


def file_references(prompt: Column) -> Column:
    """File names with a known extension, snake_case names, and CamelCase names as snake_case."""
    named = F.regexp_extract_all(prompt, F.lit(r"[\w./\\-]+\.(?:" + "|".join(W.MENTION_EXTENSIONS) + ")"), F.lit(0))
    snake = F.regexp_extract_all(prompt, F.lit(r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"), F.lit(0))
    camel = F.transform(F.regexp_extract_all(prompt, F.lit(r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b"), F.lit(0)), lambda c: F.ltrim(F.lower(F.regexp_replace(c, "([A-Z])", "_$1")), F.lit("_")))
    return F.concat(named, snake, camel)


def keyword_matches(keyword: Column, text: Column) -> Column:
    """Keywords of up to four characters match as words, longer ones anywhere."""
    return F.when(F.length(keyword) <= 4, F.regexp_like(text, F.concat(F.lit(r"\b\Q"), F.replace(keyword, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b")))).otherwise(F.contains(text, keyword))


def without_tags(prompt: Column, tags: list[str]) -> Column:
    for t in tags:
        prompt = F.regexp_replace(prompt, f"(?s)<{t}>.*?</{t}>", "")
    return F.trim(prompt)


def backtick_references(text: Column) -> Column:
    """What stands in backticks: at least three characters, no leading - or $, no space unless it is a path."""
    refs = F.regexp_extract_all(text, F.lit("`([^`\n]+)`"), F.lit(1))
    return F.filter(refs, lambda r: (F.length(r) >= 3) & ~F.startswith(r, F.lit("-")) & ~F.startswith(r, F.lit("$")) & (~F.contains(r, F.lit(" ")) | F.contains(r, F.lit("/"))))


def is_continuation(prompt: Column) -> Column:
    """A short prompt of which half the different words only go on with what was said."""
    bare = F.regexp_replace(F.trim(prompt), "[.!?,]+$", "")
    found = F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit("[a-z]+"), F.lit(0)))
    known = F.size(F.array_intersect(found, strings(W.CONTINUATION_WORDS)))
    return (F.length(bare) <= 60) & ((F.size(found) == 0) | (known / F.size(found) >= 0.5))


def task_type(text: Column, files: Column | None = None) -> Column:
    """The kind of task with the most of its words in the text; exploration without any. Files of settings count 2 for config, files of tests 1 for review, which comes last of equal ones if it has no word."""
    low = F.lower(text)
    files = F.array().cast("array<string>") if files is None else F.coalesce(files, F.array().cast("array<string>"))
    name_of = lambda f: F.element_at(F.split(f, "/"), -1)
    settings = F.exists(files, lambda f: F.regexp_like(name_of(f), F.lit(r".\.(json|yaml|yml)$"))).cast("int") * 2
    tests = F.exists(files, lambda f: F.contains(name_of(f), F.lit(".test.")) | F.contains(name_of(f), F.lit("_test."))).cast("int")
    # only words that are somewhere in the text are looked for between borders
    has = lambda low, w: F.when(F.contains(low, F.lit(w)), F.regexp_like(low, F.lit(rf"(?:^|[^a-zA-Z0-9_]){w}(?:$|[^a-zA-Z0-9_])"))).otherwise(False)

    def kind(low: Column) -> Column:
        counts = []
        for k, (name, ws) in enumerate(W.TASK_WORDS.items()):
            n = sum((has(low, w).cast("int") for w in ws), F.lit(0))
            place = F.when(n == 0, -len(W.TASK_WORDS)).otherwise(-k) if name == "review" else F.lit(-k)
            more = settings if name == "config" else tests if name == "review" else F.lit(0)
            counts.append(F.struct((n + more).alias("n"), place.alias("k"), F.lit(name).alias("name")))
        return F.greatest(*counts)

    name = F.transform(F.transform(F.array(low), kind), lambda best: F.when(best["n"] > 0, best["name"]).otherwise("exploration"))
    return F.when(text.isNull(), "exploration").otherwise(F.element_at(name, 1))


def intents(text: Column) -> Column:
    """The intents whose words a text has, in order."""
    each = [F.when(F.regexp_like(F.lower(text), F.lit(r"\b(?:" + "|".join(ws.split(" ")) + r")\b")), F.lit(name)) for name, ws in W.INTENT_WORDS.items()]
    return F.array_compact(F.array(*each))


def estimate_tokens(text: Column) -> Column:
    """Tokens of a text from its share of code, markup and prose (2.5, 3 and 4 characters each)."""
    n = F.length(text)
    only = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]", ""))
    code, md = only(r"{}\[\]();=<>|&!@#$%^*~`\\"), only(r"#\-*_>")
    lines = F.split(text, "\n")
    indented = F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("    ")) | F.startswith(x, F.lit("\t"))))
    code_part = F.least(F.lit(1.0), code / n * 10 + indented / F.greatest(F.size(lines) - 1, F.lit(1)) * 0.5)
    md_part = F.least(1.0 - code_part, md / n * 8)
    per_token = code_part * 2.5 + md_part * 3.0 + (1.0 - code_part - md_part) * 4.0
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / per_token))).cast("long")


#: Characters for a token by kind of content.
CHARS_PER_TOKEN = {"code": 2.5, "prose": 4.0, "markdown": 3.0, "mixed": 3.3}


def tokens_from_chars(chars: Column, kind: str = "mixed") -> Column:
    return F.greatest(F.lit(0), (chars / CHARS_PER_TOKEN.get(kind, 3.3)).cast("long"))


def capped_chars(n: Column) -> Column:
    """Characters that are left of an output: all up to 6,000, else a head, a tail and a note."""
    return F.when(n <= 6000, n).otherwise(1500 + 2500 + 240)


def tier(score: Column) -> Column:
    return F.when(score >= 0.8, "HOT").when(score >= 0.25, "WARM").when(score >= 0.15, "HINT").otherwise("COLD")


def decay_rate(path: Column, learned: Column | None = None) -> Column:
    """A learned rate, else one by the path's first part."""
    by_prefix = F.when(path.startswith("systems/"), 0.85).when(path.startswith("modules/"), 0.70).when(path.startswith("integrations/"), 0.80).when(path.startswith("docs/"), 0.75).otherwise(0.70)
    return by_prefix if learned is None else F.coalesce(learned, by_prefix)


def bucket(*parts: Column) -> Column:
    """0 to 99 from a digest of the parts: the same on every machine."""
    digest = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100).cast("int")


def holdout_arm(b: Column, baseline_pct: int = 10, observe_pct: int = 3) -> Column:
    """Three arms of an experiment by bucket."""
    return F.when(b < baseline_pct, "baseline").when(b < baseline_pct + observe_pct, "observed").otherwise("treated")


def outline(text: Column, most: int = 100) -> Column:
    """The lines that define something, at most `most` of them with a note on the rest."""
    found = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"^\s*(?:#+ |def |class |function |export |import |from )")))
    note = F.format_string("... (%d more)", F.size(found) - (most - 1))
    return F.when(F.size(found) <= most, found).otherwise(F.array_append(F.slice(found, 1, most - 1), note))


def summary(text: Column) -> Column:
    """The first five lines in one, up to 500 characters."""
    return F.substring(F.array_join(F.slice(F.split(text, "\n"), 1, 5), " "), 1, 500)


def usefulness(accessed: Column, edited: Column, injected: Column) -> Column:
    return F.when(injected > 0, F.least(F.lit(1.0), F.round((accessed + 2 * edited) / injected, 2))).otherwise(0.0)


def path_features(path: Column) -> Column:
    """Twelve numbers of a path: eight extensions, depth, test, init, config."""
    ext = extension(path)
    kinds = [F.when(ext == e, 1.0).otherwise(0.0) for e in ("py", "js", "ts", "tsx", "go", "rs", "java", "md")]
    low = F.lower(path)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    depth = F.least(F.lit(1.0), (F.size(F.split(path, "/")) - 1) / 8.0)
    return F.array(*kinds, depth, flag(low.contains("test")), flag(basename(low).startswith("__init__") | basename(low).startswith("index")), flag(low.contains("config") | low.contains("setting")))


def duration_seconds(text: str) -> int:
    """2h, 30m, 1d in seconds; anything else is an hour."""
    import re

    m = re.fullmatch(r"\s*(\d+)\s*([hmd])\s*", text or "")
    return int(m[1]) * {"m": 60, "h": 3600, "d": 86400}[m[2]] if m else 3600

"""Keywords of a page against a plain version."""

import re

from pyspark.sql import functions as F

from tracewell.functions import source as S
from tracewell.functions import words as W


def plain(path, text):
    stem = re.sub(r"(?<=.)\.[^.]*$", "", path.split("/")[-1]).lower().replace("-", " ").replace("_", " ")
    out = [w for w in stem.split() if len(w) > 2] + [w for w in [path.split("/")[-2].lower()] if len(w) > 2]
    good = lambda t: [w for w in t.lower().replace("-", " ").replace("_", " ").split() if len(w) > 3 and w not in W.STOP_WORDS]
    for line in text.split("\n"):
        line = line.strip()
        if line.startswith("#"):
            out += good(line.lstrip("#").strip())
        for b in re.findall(r"\*\*([^*]+)\*\*", line):
            out += good(b)
    out += [t.lower() for t in re.findall("`([a-zA-Z][a-zA-Z0-9_-]{3,})`", text)[:20]]
    return list(dict.fromkeys(out))


def test_page_keywords(spark):
    pages = [("docs/my-note_a.md", "# The Deep-part of it\nplain **Bold term** and `tick_word`\n## Deep again\n"), ("d/x.md", ""), ("guide/Setup.md", "**only bold** ## not a heading `abc` `ABCD`")]
    got = spark.createDataFrame(pages, "path string, text string").select(S.page_keywords(F.col("path"), F.col("text")).alias("k")).collect()
    assert [r.k for r in got] == [plain(*p) for p in pages]


def test_all_notes_by_prefix(spark):
    """The only note that begins so, or all that do."""
    from tracewell.operators import monitors as M

    notes = spark.createDataFrame([(9999,), (99991,), (123,)], "id long")
    assert M.by_prefix(notes, "9999").count() == 0 and M.by_prefix(notes, "12").count() == 1
    assert sorted(r.id for r in M.by_prefix(notes, "9999", only=False).collect()) == [9999, 99991]

"""The logical tables hold all of the tables that they stand for."""

import re
from collections import defaultdict

from conftest import SF

from tracewell.plans.views import view


def test_edges_hold_all_transitions(spark):
    seen, want = defaultdict(list), set()
    for e in spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "props").orderBy("event_id").collect():
        seen[e.user_id].append("file_" + re.search("[0-9]+", e.props)[0])
    for files in seen.values():
        want |= {(a, b) for a, b in zip(files, files[1:], strict=False) if a != b}
    assert {tuple(r) for r in view(spark, SF, "edges").select("src", "dst").collect()} == want


def test_pages_hold_whole_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pages = {r.doc_id: r.content for r in view(spark, SF, "pages_md").collect()}
    assert pages.keys() == texts.keys() and all(pages[k].endswith("\n" + t) for k, t in texts.items() if t is not None)

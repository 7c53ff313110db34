import hashlib
import re

from foliospark.llm.exact_dedup import exact_dedup, without_copies

SPACE = re.compile(r"[\x20\x09-\x0D]+")
ROWS = [
    (5, "a b c"), (3, "ab c "), (9, "abc"), (1, None), (2, ""), (4, " \n\t"), (7, "x"), (7, "x"), (None, "y"), (None, "y"), (6, "a b"), (8, "a b"),
    *[(100 + k, "hot  text") for k in range(60)],
]


def brute(rows):
    groups = {}
    for k, (doc_id, text) in enumerate(rows):
        groups.setdefault(SPACE.sub("", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, k))
    out = []
    for bare, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str)


def test_brute_force(docs_of):
    got = exact_dedup(docs_of(ROWS)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(ROWS)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len({SPACE.sub("", t or "") for _, t in ROWS})


def test_many_runs_merge_in_rounds(docs_of):
    """Runs of many tasks, with very long texts and one text in all of them."""
    rows = [*ROWS, *((1000 + k, "hot text") for k in range(300)), (2000, "long " * 400_000), (2001, "long" * 400_000)]
    got = exact_dedup(docs_of(rows).repartition(40)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(rows)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept))


def test_survivors_keep_columns(docs_of):
    docs = docs_of(ROWS)
    got = without_copies(docs)
    assert got.columns == docs.columns
    bare = [SPACE.sub("", r["text"] or "") for r in got.collect()]
    assert len(bare) == len(set(bare)) == len({SPACE.sub("", t or "") for _, t in ROWS})


def test_empty_table(docs_of):
    assert exact_dedup(docs_of([])).count() == 0
    assert without_copies(docs_of([])).count() == 0

"""Windows that many benchmark items share, in many documents: as a scan finds them, without a row for each of both."""

import hashlib

from revisit_spark.llm.decontaminate import _hits, _item_lists, item_windows, matches, report

SHARED = "the quick brown fox jumps over the lazy dog today again"
OTHER = "nine more words stand here so that items differ somewhere"


def test_shared_windows(spark):
    items = [(f"i{k}", f"{SHARED} own{k}") for k in range(60)]
    items += [("1", OTHER), ("2", OTHER), ("1,2", SHARED + " " + OTHER), (None, OTHER.upper()), ("", "rare"), ("empty", None), ("i0", f"{SHARED} own0")]
    texts = {n: f"start {n} {SHARED} end" for n in range(40)}
    texts |= {100: f"{OTHER} x", 101: f"{SHARED} {OTHER} {SHARED}", 102: "Rare and RARE", 103: None, 104: "", 105: "nothing of it", 106: f"{OTHER} rare {SHARED} own7", 107: "own7"}
    docs = spark.createDataFrame([*texts.items(), (100, f"{OTHER} x"), (None, SHARED)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = report(docs, bench).collect()
    assert len(got) == len(texts) + 2
    seen = {}
    for i, t in [*texts.items(), (None, SHARED)]:
        w, hit, found = (t or "").lower().split(), set(), set()
        for item, x in items:
            x = (x or "").lower().split()
            for a in range(len(x) - min(len(x), 10) + 1) if x else ():
                part = x[a : a + 10]
                for k in range(len(w) - len(part) + 1):
                    if w[k : k + len(part)] == part:
                        hit |= set(range(k, k + len(part)))
                        found.add(item or "")
        seen[i] = (len(w), len(hit), sorted(found), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    for r in got:
        assert (r.n_words, r.n_hit, list(r["items"]), r.n_items, r.items_sha256, r.contaminated) == seen[r.doc_id]
    windows = item_windows(bench)
    named, lists = _item_lists(windows)
    assert named.count() == windows.select("content").distinct().count() and lists.count() < named.count()
    _, hits = _hits(docs, windows, named, 10, 3, "text", "doc_id")
    _, each = matches(docs, bench)
    assert hits.count() < 150 and each.count() > 40 * 60

"""D6 against the fold over all accepted titles."""

import random
import re

from __spark_entry__ import queries


def test_token_sets_at_085(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    base = [rng.sample(words, 14) for _ in range(30)]
    titles = []
    for i in range(300):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(14)] = rng.choice(words)
        rng.shuffle(w)
        titles.append(" ".join(w) if i % 50 else "")
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    kept, want = [], set()
    for i, t in enumerate(titles):
        own = set(re.findall(r"\w+", t[:120].lower()))
        if not own or all(len(own & k) / len(own | k) < 0.85 for k in kept):
            want.add(i)
            kept += [own] if own else []
    exact = {r.doc_id for r in queries()["d6_token_set"](spark, str(tmp_path)).collect()}
    assert {r.doc_id for r in queries()["d6_token_set_near"](spark, str(tmp_path)).collect()} == want and len(want) < len(exact)

"""run() against a plain version of all five stages."""

import math
import random
import statistics
import zlib

import numpy as np
import pytest
from test_duplicates import shingles, union_find
from test_models import base_rules, kneser_ney
from tokenizers import Tokenizer

from tessera.llm import line_dedup

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def tables(rng):
    vocab = {k: ["".join(rng.choice(a) for _ in range(rng.randint(2, 8))) for _ in range(300)] for k, a in (("en", "aeioulnrst"), ("de", "aeioubcdfg"))}

    def sentence(lang, n):
        return " ".join(rng.choices(vocab[lang], k=n))

    items = [(i, sentence("en", 25)) for i in range(6)]
    shared = [sentence("en", 30) for _ in range(3)]
    docs = []
    for i in range(120):
        lang = "de" if i % 4 == 0 else "en"
        lines = [sentence(lang, rng.randint(15, 40)) for _ in range(rng.randint(2, 6))]
        if i % 7 == 0:
            lines.insert(1, rng.choice(shared))
        if i % 10 == 3:
            lines[-1] += " " + items[i // 10 % 6][1]
        docs.append((lang, "\n".join(lines)))
    for i in range(0, 30, 3):  # near copies: a word added to each line, so that lines of 12 words differ more than lines may
        lang, text = docs[i]
        docs.append((lang, text if i % 2 else "\n".join(x + " " + rng.choice(vocab[lang]) for x in text.split("\n"))))
    docs += [("en", "0#9 x%q " * 3 + " ".join("".join(rng.choice("0123456789#%&xq") for _ in range(5)) for _ in range(60))), ("en", "spam ham " * 40), ("en", "few words"), ("en", ""), ("en", None), (None, "\n")]
    return docs, items


def brute(docs, items):
    rows = [(i, lang, t) for i, (lang, t) in enumerate(docs)]
    # Quality rules.
    langs, surprise = {lang or "" for _, lang, _ in rows}, {}
    for g in langs:
        p = kneser_ney([t for _, lang, t in rows if (lang or "") == g and t])
        for i, lang, t in rows:
            if (lang or "") == g and t and t.split():
                u, words, inside = "\n\n\n" + t, [], False
                for k in range(len(t)):
                    space = t[k] in " \n"
                    if not space and not inside:
                        words.append(0.0)
                    inside = not space
                    words = words or [0.0]
                    words[-1] -= math.log(p[u[k : k + 4]])
                parts = [words[k : k + 16] for k in range(0, len(words), 16)]
                if len(parts) > 1 and len(parts[-1]) < 16:
                    parts[-2:] = [parts[-2] + parts[-1]]
                surprise[i] = statistics.median(sum(x) / len(x) for x in parts)
    kept = []
    for g in langs:
        own = [(i, lang, t) for i, lang, t in rows if (lang or "") == g]
        some = [surprise[i] for i, _, _ in own if i in surprise]
        middle = statistics.median_low(some) if some else 0
        off = {i: (surprise.get(i, 0) - middle) / math.sqrt(1 + 100 / max(1, base_rules(t)[0])) for i, _, t in own}
        spread = 1.4826 * statistics.median_low([abs(off[i]) for i, _, _ in own if i in surprise] or [0])
        for i, lang, t in own:
            n, *_, repeat = base_rules(t)
            if n >= 20 and 100 * repeat <= 30 * n and (not spread or -8 <= off[i] / spread <= 6):
                kept.append((i, lang, t))
    kept.sort()
    # Line dedup.
    lines = [(i, k, line_dedup.plain(x)) for i, _, t in kept for k, x in enumerate(t.lower().split("\n"))]
    lines = [x for x in lines if len(x[2]) >= 40]
    sets = {x: set(line_dedup.shingle_set(x).tolist()) for _, _, x in lines}
    names = sorted(sets)
    root = union_find(names, [(a, b) for n, a in enumerate(names) for b in names[n + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    first, gone = {}, set()
    for i, k, x in lines:
        if first.setdefault(root[x], (i, k)) != (i, k):
            gone.add((i, k))
    kept = [(i, lang, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, lang, t in kept]
    kept = [r for r in kept if r[2].strip()]
    # Near duplicates.
    sh = {i: shingles(t, 5) for i, _, t in kept}
    ids = sorted(sh)
    root = union_find(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sh[a] and sh[b] and 100 * len(sh[a] & sh[b]) >= 80 * len(sh[a] | sh[b])])
    kept = [r for r in kept if root[r[0]] == r[0]]
    # Benchmark.
    return [(i, t) for i, _, t in kept if not any(x in t for _, x in items)]


def test_run(spark, tmp_path, byte_bpe):
    docs, items = tables(random.Random(11))
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, (lang, t) in enumerate(docs)]
    sf = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    want = dict(brute(docs, items))
    assert len(want) < len(docs) - 25
    library = Tokenizer.from_file(byte_bpe)
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(want)
    for i, t in want.items():
        ids, at = [*library.encode(t, add_special_tokens=False).ids, 0], 0
        for r in sorted(by_doc[i], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 2048) + 1


def test_stage_columns(spark, tmp_path):
    docs, items = tables(random.Random(12))
    sf = f"file://{tmp_path}"
    frame = spark.createDataFrame([(i, t, lang, "s", 0, "x") for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long, node string")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, sf).columns == frame.columns
        assert stage(spark, frame.where("false"), sf).count() == 0

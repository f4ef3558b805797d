"""Operators that SQL can't express, against their definitions written plainly; and the pipeline."""

import hashlib
import math
import random

import numpy as np
import regex
from pyspark.sql import functions as F

from tessera.llm import op1_pii, op6_bpe, op7_fingerprint

MASK = (1 << 64) - 1


def mix(x):
    x = ((x ^ (x >> 31)) * 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & MASK
    return x ^ (x >> 32)


def label(left, own):
    """Twice the lowest bit in which the two differ, and that bit of the second."""
    low = ((left ^ own) & -(left ^ own)).bit_length() - 1
    return 2 * low + (own >> low & 1)


def next_level(names):
    runs = []
    for n in names:
        if runs and runs[-1][0] == n:
            runs[-1][1] += 1
        else:
            runs.append([n, 1])
    symbols = [n if k == 1 else mix((n + mix(k)) & MASK) for n, k in runs]
    labels = symbols
    for _ in range(4):
        labels = [label(labels[i - 1] if i else own ^ 1, own) for i, own in enumerate(labels)]
    assert all(x < 6 for x in labels)
    phrases = []
    for i, s in enumerate(symbols):
        if i == 0 or (0 < i < len(symbols) - 1 and labels[i - 1] < labels[i] > labels[i + 1]):
            phrases.append([])
        phrases[-1].append(s)
    return [mix(sum(mix((s + mix(k + 1)) & MASK) for k, s in enumerate(p)) & MASK) for p in phrases]


def plain_fingerprint(text):
    names = [mix(b + 1) for b in text.encode()]
    least = {}
    for k in range(1, max(op7_fingerprint.LEVELS) + 1):
        names = next_level(names) if names else []
        for n in names if k in op7_fingerprint.LEVELS else ():
            h = mix(n ^ k)
            slot, rest = (h >> 58) % op7_fingerprint.SLOTS, h & ((1 << 58) - 1)
            least[slot] = min(rest, least.get(slot, MASK))
    out = []
    for slot in range(op7_fingerprint.SLOTS):
        way = next((w for w in range(op7_fingerprint.SLOTS) if (slot + w) % op7_fingerprint.SLOTS in least), None)
        value = 0 if way is None else mix((least[(slot + way) % op7_fingerprint.SLOTS] + way) & MASK) & 0xFFFF
        out.append(value)
    return out


def test_fingerprints_by_definition():
    rng = random.Random(31)
    texts = ["", "a", "aa", "ab", "a" * 500, "ab" * 300, "é😀" * 40, "abc" * 100 + "x" + "abc" * 100]
    texts += ["".join(rng.choices("abcdefgh ", k=rng.randint(1, 700))) for _ in range(60)]
    got = op7_fingerprint.fingerprints(texts)
    assert [list(map(int, row)) for row in got] == [plain_fingerprint(t) for t in texts]


LETTERS = r"\p{L}\p{M}"


def plain_terms(spark, rows):
    """The spans of disclosing terms of each row, by the description of the operator. Base spans are taken as they are found."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    base = {(r["__id"], r["__text"]): r["__spans"] for r in op1_pii.base_spans(df.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text")), "__text").collect()}
    digits = lambda v: regex.sub("[^0-9]", "", v)
    entities = lambda row: {s["kind"] + ":" + (digits(s["value"]) if s["kind"] in ("card", "phone") else s["value"].lower()) for s in base[row]}
    terms = lambda t: set(regex.findall(rf"(?<![{LETTERS}@.0-9])[{LETTERS}]+(?=[.]?(?:[^{LETTERS}@.0-9]|$))", t.lower()))
    n = max(2, len(rows))
    n_e, texts_e, n_te, texts_te, n_t = {}, {}, {}, {}, {}
    for row in rows:
        for w in set(regex.split(rf"[^{LETTERS}]+", row[1].lower())):
            n_t[w] = n_t.get(w, 0) + 1
        for e in entities(row):
            n_e[e] = n_e.get(e, 0) + 1
            texts_e.setdefault(e, set()).add(row[1])
            for w in terms(row[1]):
                n_te[e, w] = n_te.get((e, w), 0) + 1
                texts_te.setdefault((e, w), set()).add(row[1])
    known = {}
    for (e, w), k in n_te.items():
        if len(texts_te[e, w]) >= op1_pii.MIN_TEXTS:
            told = math.log2(n * k / (n_t[w] * n_e[e])) / max(math.log2(n / n_e[e]), 1e-9)
            if told >= op1_pii.GENERALISE:
                known[e, w] = min(told, 1.0)
    out = {}
    for row in rows:
        found = {}
        for e in entities(row):
            for w in terms(row[1]):
                if (e, w) in known:
                    found[w] = max(found.get(w, 0), known[e, w])
        spans = []
        for kind, holds in (("general", lambda x: x < op1_pii.REMOVE), ("term", lambda x: x >= op1_pii.REMOVE)):
            own = sorted(w for w, x in found.items() if holds(x))
            pattern = rf"(?<![{LETTERS}])(?:{'|'.join(own)})(?![{LETTERS}])"
            for m in regex.finditer(pattern, row[1], regex.I) if own else ():
                if not any(s["start"] < m.end() and m.start() < s["end"] for s in base[row]):
                    spans.append((kind, m.start(), m.end()))
        out[row] = spans
    return out


def test_disclosing_terms_by_definition(spark):
    rng = random.Random(32)
    common = [f"common{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(150):
        words = rng.choices(common, k=12)
        if i % 3 == 0:
            who = rng.randrange(6)
            words[4:4] = [f"{'ABCDEF'[who]}mith", f"{'abcdef'[who]}@mail.org"]
            if rng.random() < 0.4:
                words.append("Team" + "xyz"[who % 3])
        if i % 10 == 0:
            words += ["+1 386 555 3733", "Kontor"]
        rows.append((i if i % 7 else None, " ".join(words) + "."))
    rows += [rows[0], rows[30], (500, rows[30][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = op1_pii.find(df, whole=True).collect()
    wanted = plain_terms(spark, rows)
    assert len(got) == len(rows)
    seen = [((r["doc_id"], r["text"]), [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in ("general", "term")]) for r in got]
    assert any(spans for _, spans in seen) and {k for _, spans in seen for k, _, _ in spans} == {"general", "term"}
    assert all(spans == wanted[row] for row, spans in seen)


def test_very_many_matches(spark):
    texts = [" ".join(f"a{i}@b.org" for i in range(n)) for n in (0, 1, 63, 64, 65, 66, 1000, 30_000)]
    got = op1_pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        spans = [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "email"]
        assert spans == [m.span() for m in regex.finditer(r"[^ ]+", texts[r["doc_id"]])]


# The pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars int, rate string, __key int, simhash int, text2 string"


def lay_out(spark, folder, rows, labels=()):
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), "r", 1, 2, "x") for i, t, lang in rows], DOCS).repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers

    rng = random.Random(33)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijk", k=6)) for _ in range(n))
    notice = "all rights of this page are reserved"
    texts = [f"{words(30)}\n{notice}\n{words(9)}" for _ in range(30)]
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)]
    rows += [(None, words(40), None), (None, words(41), "en"), (100, texts[3], "en"), (None, texts[4], None), (101, None, "en"), (102, "12 34 --", "en"), (103, "", None), (3, words(50), "en"), (3, words(50), "und"), rows[5], (104, " " * 5000 + "x", "en")]
    folder = lay_out(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    got = corpus_pipeline.run(spark, folder).collect()
    # By hand: no letters, no document; the notice goes; of copies one stays; without labels every text is clean and stays.
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    kept, seen = [], set()
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        t = None if t is None or not regex.search(r"\p{L}", t) else "\n".join(x for x in t.split("\n") if x != notice)
        if t is not None and t not in seen:
            seen.add(t)
            kept.append((i, t))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert {(r["doc_id"], r["decoded_sha256"]) for r in got} == {(i, sha(t.encode())) for i, t in kept}
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert r["n_tokens"] == len(ids) and sha(op6_bpe.decode(ids, path)) == r["decoded_sha256"]


def test_pipeline_without_rows_or_languages(spark, tmp_path):
    import corpus_pipeline

    folder = lay_out(spark, tmp_path / "a", [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    folder = lay_out(spark, tmp_path / "b", [(1, "plain words of a text", None), (None, "слова другого текста", None), (2, "42", None)])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == {1, None}

"""Numbered operators against plain versions, on planted rows and on the smallest data set."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import pytest

from ledgerlens.llm import chat, components as stars, hamming, language, minhash, packing, passages, pieces, registry, sharding, topk, toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, size string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(d, t, None if t is None else "en", "s", None, "x", None) for d, t in rows], SCHEMA)


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    """Copies, near copies, shared passages, repeated words, nulls, empty texts, ties and repeated rows."""
    rng = random.Random(7)
    base = [words(rng, 300) for _ in range(6)]
    rows, number = [], 0

    def add(text):
        nonlocal number
        number += 1
        rows.append((number, text))

    for own in base:
        add(" ".join(own))
    for own in base[:3]:
        for _ in range(6):  # near copies
            near = list(own)
            for _ in range(rng.randrange(1, 4)):
                near[rng.randrange(len(near))] = f"edit{rng.randrange(99)}"
            add("\n".join(near))
    passage = words(rng, 70)
    for size in (49, 50, 51, 70):
        add(" ".join(words(rng, 40) + passage[:size] + words(rng, 30)))
    add(" ".join(passage[20:] + base[4][:120] + passage[:60]))
    add("again " * 400)
    add("again\t" * 90)
    add(" ".join(["again"] * 60 + base[5] + ["again"] * 60))
    for _ in range(5):
        add(" ".join(base[3]))
    add(None), add(""), add("  \t "), add("one"), add("ONE"), add("one two three four"), add("a\x1cb\x85c é É ß")
    rows += [rows[0], rows[0], (None, " ".join(base[0])), (None, None), (5, " ".join(base[1]))]
    rows.append((999, " ".join(words(rng, 9000, 3000) + base[2])))
    return rows


def test_sharding(spark, planted):
    for rows in (planted, []):
        found = sharding.shard_rows(frame(spark, rows), 40).collect()
        assert len(found) == len(rows)
        want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == want
        slots = defaultdict(list)
        for r in found:
            key = 0x5EED if r.doc_id is None else r.doc_id
            assert (r.shard, r.grown_shard) == (brute.jump(key, 40), brute.jump(key, 41))
            assert r.grown_shard in (r.shard, 40)
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_jump_hash_is_even_and_steady():
    keys = np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    before, after = sharding.jump_hash(keys, 10), sharding.jump_hash(keys, 11)
    assert np.bincount(before).min() > 1800 and ((before == after) | (after == 10)).all()
    assert [int(s) for s in sharding.jump_hash(keys[:200], 7)] == [brute.jump(int(k), 7) for k in keys[:200]]


def test_written_shards(spark, planted, tmp_path):
    docs = frame(spark, planted).drop("shard")
    sharding.write_shards(docs, str(tmp_path / "out"), 8, files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(planted) and back.filter("doc_id = 3").first().shard == brute.jump(3, 8)


def check_packing(found, rows, capacity):
    by_doc = brute.token_pieces(rows, capacity)
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found)
    assert pieces == Counter((d, *p) for d, copies in by_doc.items() for own in copies for p in own)
    fills = defaultdict(list)
    for r in found:
        fills[r.sequence_id].append((r.offset, r.length))
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    counts = np.bincount([r.length for r in found], minlength=capacity + 1) if found else np.zeros(capacity + 1, int)
    return len(fills), packing.lower_bound(counts, capacity)


@pytest.mark.parametrize("per_task", [40, 20_000])
def test_packing(spark, planted, per_task):
    found = packing.pack_documents(frame(spark, planted), 512, pieces_per_task=per_task).collect()
    used, bound = check_packing(found, planted, 512)
    assert bound <= used <= bound + 1
    assert packing.pack_documents(frame(spark, [])).count() == 0


@pytest.mark.parametrize("case", ["one a round", "nearly full"])
def test_packing_goes_on_while_it_saves(spark, monkeypatch, case):
    def packed(rows, capacity, turn):
        """One more piece joins the first sequence each round; or all pieces, once they are opened."""
        joined = min(turn, 9) if case == "one a round" else 9 * min(turn, 1)
        fill = 1 if case == "one a round" else capacity - 1
        out = [(r.id, r.length, max(r.id - joined, 0) + (turn << 48), min(r.id, joined) if r.id <= joined else 0, fill, int(case == "one a round"))
               for r in rows.select("id", "length").collect()]
        return spark.createDataFrame(out, "id bigint, length bigint, sequence_id bigint, offset bigint, _fill bigint, _gap bigint")

    monkeypatch.setattr(packing, "_packed", packed)
    pieces = spark.range(10).withColumn("length", packing.F.lit(1).cast("bigint"))
    found = packing.pack(pieces, 128).collect()
    assert len(found) == 10 and len({r.sequence_id for r in found}) == 1


def test_packed_ids_are_the_tokens(spark):
    rows = [(1, "It's the End."), (2, "a<|endoftext|>b"), (3, None)]
    found = {r.doc_id: r.ids for r in packing.pack_documents(frame(spark, rows), with_ids=True).collect()}
    tokenizer = packing.encoder(packing.public_tokenizers.path("word_bpe_49k.json")).tokenizer
    assert found == {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows}


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = rng.integers(1, 60, rng.integers(1, 60)) if rng.random() < 0.5 else rng.choice([26, 34, 51, 17, 90], rng.integers(1, 40))
        bins, offsets, fills = packing.best_fit_decreasing(lengths, 100)
        assert fills.max() <= 100 and np.bincount(bins, lengths).astype(int).tolist() == fills.tolist()
        bound = packing.lower_bound(np.bincount(lengths, minlength=101), 100)
        assert max(-(-int(lengths.sum()) // 100), int((lengths > 50).sum())) <= bound <= len(fills)


def test_repeated_passages(spark, planted):
    want = brute.repeats(planted)
    found = passages.without_repeats(frame(spark, planted)).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(planted)
    for r in found:
        assert tuple(r._kept) == want[r.doc_id, r.text], r.doc_id
    assert sum(r._kept.n_removed for r in found) > 3000
    assert passages.without_repeats(frame(spark, [])).count() == 0


def test_repeated_passages_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute.repeats(rows)
    for r in registry.op5_repeated_passages(spark, SF).collect():
        n, gone, kept = next(v for (d, _), v in want.items() if d == r.doc_id)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, brute.sha(kept))


def test_triples_cover():
    triples = hamming.byte_triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_simhash(spark, planted):
    want = brute.components([(d, brute.fingerprint(t)) for d, t in planted])
    found = hamming.near_duplicates(frame(spark, planted)).collect()
    assert len(found) == len(planted)
    marks = {t: brute.fingerprint(t) for _, t in planted}
    expected = Counter((d, marks[t], c) for (d, t), c in zip(planted, want))
    assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in found) == expected
    assert hamming.near_duplicates(frame(spark, [])).count() == 0


def test_keep_one(spark, planted):
    rows = [p for p in planted if p[0] is not None]
    want = {c for c in brute.components([(d, brute.fingerprint(t)) for d, t in rows])}
    kept = hamming.keep_one(frame(spark, rows))
    assert kept.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert hamming.keep_one(frame(spark, [(None, None), (None, "x"), (None, "x")])).count() == 2


def test_links_of_a_long_list(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = {base}
    while len(values) < 300:  # a chain of neighbours in one list
        value = rng.choice(sorted(values))
        for bit in rng.sample(range(64), rng.randrange(1, 6)):
            value ^= 1 << bit
        values.add(value)
    values |= {rng.getrandbits(64) for _ in range(200)}
    signed = sorted(v - 2**64 if v >> 63 else v for v in values)
    links = hamming.hamming_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), chunk=40)
    found = {r.node: r.label for r in stars.components(links).collect()}
    want = brute.components([(v, v & (2**64 - 1)) for v in signed])
    assert [found.get(v, v) for v in signed] == want


def test_language(spark, planted):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10_001, None, None), (10_002, "", "en"), (10_003, "12 %&", "en"), (10_004, None, "fr")], docs.schema)
    found = {r.doc_id: r for r in language.identify(docs.unionByName(odd)).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    out = [d for d in lang if found[d].held_out]
    assert set(out) == {d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([found[d].lang_pred == lang[d] for d in out]) > 0.97
    assert all((found[d].lang_pred, found[d].score) == ("und", 0.0) for d in range(10_001, 10_005))
    assert all(0 <= r.score <= 1 for r in found.values())
    nothing = language.identify(frame(spark, [(d, t) for d, t in planted if t is None] + [(3, None)])).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language.identify(frame(spark, [])).count() == 0
    assert language.keep_known(docs.unionByName(odd)).count() == docs.count()


def test_language_of_many_letters():
    rng = random.Random(9)
    wide = ["".join(chr(0x4E00 + rng.randrange(18_000)) for _ in range(600)) for _ in range(20)]
    old = {name: [" ".join("".join(chr(rng.randrange(low, low + 20)) for _ in range(5)) for _ in range(30)) for _ in range(20)]
           for name, low in (("got", 0x10330), ("phn", 0x10900))}
    texts, names = [t for own in zip(wide, *old.values()) for t in own], ["zh", *old] * 20
    model = language.fit(texts, names)
    seen = {own for t in texts for own in brute_grams(t)}
    assert len(seen) > 20_000 and len(model.vocabulary) == len(seen)
    present = language.Scorer(model.vocabulary).presence(texts[:6])
    assert present.sum(1).tolist() == [len(brute_grams(t)) for t in texts[:6]]
    assert [own for own, _ in language.score(model, texts)] == names


def brute_grams(text):
    plain = "".join(c.lower() if c.isalpha() else " " for c in text)
    while "  " in plain:
        plain = plain.replace("  ", " ")
    return {plain[i:i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1)}


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    odd = spark.createDataFrame([(None, None), (20_002, ""), (20_003, None)], docs.schema)
    found = {r.doc_id: r for r in toxicity.classify(docs.unionByName(odd), labels).collect()}
    marks = {r.doc_id: r.toxic for r in labels.collect() if found[r.doc_id].held_out}
    right = np.mean([found[d].predicted == t for d, t in marks.items()])
    caught = np.mean([found[d].predicted for d, t in marks.items() if t])
    assert right > 0.97 and caught > 0.8
    assert found[20_002].score == found[20_003].score == found[None].score and not found[None].held_out
    none = toxicity.classify(frame(spark, [(1, "x"), (2, None)]), labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0} and len(none) == 2


def test_repeated_ids_leave_room_to_learn(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEARN_PER_LABEL", 20)
    ids = [n for n in range(1, 99) if zlib.crc32(str(n).encode()) % 5][:40]
    texts = [f"you vile rat {n}" if k % 2 else f"you kind soul {n}" for k, n in enumerate(ids)]
    for hot in (0, 1):  # a clean one and a toxic one
        rows, marks = list(zip(ids, texts)), [(n, k % 2) for k, n in enumerate(ids)]
        docs = spark.createDataFrame(rows[:hot] + [rows[hot]] * 60 + rows[hot + 1:], "doc_id bigint, text string")
        labels = spark.createDataFrame(marks + [marks[hot]] * 60, "doc_id bigint, toxic int")
        for given in (docs, spark.createDataFrame(rows, docs.schema)):
            for marked in (labels, spark.createDataFrame(marks, labels.schema)):
                model = toxicity.learn(given, marked)
                assert {"vile$", "rat$"} <= set(model.index)
                assert [s >= 0.5 for s in toxicity.score(model, texts)] == [k % 2 == 1 for k in range(40)]


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    truth = (rng.random(4000) < 0.3).astype(int)
    good = (rng.random(4000) < np.where(truth, 0.8, 0.05)).astype(float)
    poor = (rng.random(4000) < 0.3).astype(float)
    posterior, accuracies, noise = toxicity.label_model(np.stack([good, good, poor], 1), truth, np.ones(4000))
    assert accuracies[0, 1] - accuracies[0, 0] > 0.6 > 0.1 > abs(accuracies[2, 1] - accuracies[2, 0])
    assert noise[0, 1] > 0.8 and noise[0, 2] == 0 and ((posterior > 0.5) == truth).mean() > 0.97


def brute_top(rows, asked, k=10):
    out = {}
    whole = {i: np.array([int(x) for x in np.floor(1024 * np.asarray(v, float))], object) for i, v in rows}
    for q in asked:
        scored = sorted((-int((whole[q] * x).sum()), i) for i, x in whole.items() if i != q and len(x) == len(whole[q]))
        out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("case", ["even", "clustered", "large"])
def test_top_k(spark, case):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(900, 8))
    if case == "clustered":
        base = rng.normal(size=(6, 8))[rng.integers(0, 6, 900)] * rng.choice([1.0, 1.02, 3.0], (900, 1))
    if case == "large":
        base *= 2e5
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(i, rows[7][1]) for i in range(900, 1300)] + [(1300 + i, [float(i), 1.0]) for i in range(3)] + [(1400, []), (1500, [])]
    odd = [(2000, None), (2100, [None] * 8), (2200, [float("nan")] * 8), (2300, [float("inf")] + [0.0] * 7), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id bigint, embedding array<double>, rank int")
    found = topk.top_k(df, df.filter("vec_id % 100 = 0"), annulus=64, query_block=4).collect()
    want = brute_top(rows, [i for i, _ in rows if i % 100 == 0])
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert got == {q: own for q, own in want.items() if own}
    empty = df.limit(0)
    assert topk.top_k(empty, empty).count() == 0
    twice = topk.top_k(df.filter("vec_id < 20"), df.filter("vec_id = 0").unionByName(df.filter("vec_id = 0")))
    assert twice.count() == 10


def test_registered_sql(spark):
    from workload.compare import sql_connection

    con = sql_connection(SF)
    for name, sql in registry.ORACLES.items():
        df = registry.QUERIES[name](spark, SF)
        result = con.execute(sql)
        names = [c[0] for c in result.description]
        assert Counter(map(tuple, df.select(*names).collect())) == Counter(result.fetchall()), name


def test_fingerprints(spark, planted):
    found = {(r.doc_id, r.n_chars): r for r in minhash.compared_with_edits(frame(spark, [p for p in planted if p[0] != 1])).collect()}
    docs = sorted([p for p in planted if p[0] not in (1, None)], key=lambda p: p[0])
    docs = [(d, t or "") for d, t in docs if d != 5]
    follow = dict(zip([d for d, _ in docs], docs[1:]))
    for d, t in docs[:-1]:
        if d == 4 or (d, len(t)) not in found:  # document 5 comes twice
            continue
        row, (_, after) = found[d, len(t)], follow[d]
        quarter = len(t) // 4
        edited = t[:len(t) - quarter] + after[:quarter]
        assert row.edited_sha256 == brute.sha(edited), d

        def shingles(text):
            w = text.encode().split()
            return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

        a, b, c = shingles(t), shingles(edited), shingles(after)
        for guess, other in ((row.near_edited, b), (row.near_next, c)):
            assert abs(guess - (len(a & other) / len(a | other) if a | other else 1)) < 0.17
    same = defaultdict(set)
    for r in minhash.fingerprints(frame(spark, planted)).withColumnRenamed("fingerprint", "f").collect():
        same[next(t or "" for d, t in planted if d == r.doc_id)].add(tuple(r.f)) if r.doc_id not in (5, None) else None
    assert all(len(v) == 1 for v in same.values())
    assert len({f for v in same.values() for f in v}) > 20
    one = minhash.compared_with_edits(frame(spark, [(1, "a b c d e f g")])).first()
    assert one.near_next == 1.0 and one.fingerprint == one.fingerprint.lower() and len(one.fingerprint) == 256
    assert minhash.compared_with_edits(frame(spark, [])).count() == 0


def test_next_document_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(minhash, "ROWS_PER_RANGE", 3)
    ids = [None, None, *range(0, 40, 3), 1000, 1001, 10**9, -5]
    df = spark.createDataFrame([(d, f"t{i}") for i, d in enumerate(ids)], "doc_id bigint, text string")
    found = {r.text: r.next.text for r in minhash.with_next(df, ["text"]).collect()}
    real = [f"t{i}" for i in sorted(range(2, len(ids)), key=lambda i: ids[i])]
    assert all(found[a] == b for a, b in zip(real, real[1:]))
    assert {found["t0"], found["t1"], found[real[-1]]} == {"t0", "t1", real[0]} and len(set(found.values())) == len(ids)


def cheapest(roles):
    """Least repair cost by trying every state after every turn."""
    costs = {chat.START: 0}
    for given in roles:
        nxt = {}
        for state, paid in costs.items():
            for target in (1, 2, 3):
                step = int(chat.STEP[given, state, target])
                if step < chat.NEVER:
                    nxt[target] = min(nxt.get(target, chat.NEVER), paid + step)
        costs = nxt
    return min(paid + int(chat.END[s]) for s, paid in costs.items())


def test_chat(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS_PER_TASK", 40)
    rng = random.Random(8)
    rows = []
    for conv in range(40):
        for t in range(rng.randrange(1, 9)):
            rows.append((conv, t, rng.choice(["system", "user", "assistant", "User ", "bot", "tool", None]), f"c{conv}t{t}"))
    rows += [(77, t, rng.choice(["user", "assistant", "system"]), f"t{t}") for t in range(1500)]
    rows += [(78, 0, "user", "same")] * 600 + [(None, 1, "assistant", None), (None, None, "user", "first"), (79, 3, "user", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn int, role string, text string, fragment string")
    found = chat.repair(df).collect()
    assert Counter((r.conv_id, r.turn) for r in found) == Counter((c, t) for c, t, *_ in rows)
    by_conv, given = defaultdict(list), defaultdict(list)
    for r in sorted(found, key=lambda r: r.place):
        by_conv[r.conv_id].append(r)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        given[r[0]].append(r)
    for conv, own in by_conv.items():
        roles = [chat.role_number(r[2]) for r in given[conv]]
        relabelled = sum((chat.NAME if g == 3 else chat.RELABEL) for g, r in zip(roles, own) if "relabel" in r.action)
        paid = relabelled + sum(chat.MERGE * r.action.startswith("merge") + chat.INSERT * r.inserted for r in own)
        assert paid == cheapest(roles), conv
        line = "".join(r.fragment for r in own)
        parts = line.split("<|im_end|>\n")
        assert parts.pop() == ""
        names = [p.removeprefix("<|im_start|>").split("\n", 1)[0] for p in parts]
        names = names[1:] if names[0] == "system" else names
        assert names == ["user", "assistant"] * (len(names) // 2) and names, conv
        assert all((r[3] or "") in line for r in given[conv])
    assert chat.repair(df.limit(0)).count() == 0
    whole = {r.conv_id: r.rendered for r in chat.render(chat.repair(df)).collect()}
    assert whole[79] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"


@pytest.mark.parametrize("chunk", [64, 65_536])
def test_sentence_pieces(spark, planted, chunk):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=pieces.public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(6)
    odd = ["".join(rng.choice("abet  in ionthe▁\n.é日🙂") for _ in range(rng.randrange(1, 400))) for _ in range(40)]
    rows = planted + [(5000 + i, t) for i, t in enumerate(odd + ["x" * 700, " " * 300, "<s></s>", "日本語" * 90])]
    found = pieces.encode(frame(spark, rows), chunk=chunk)
    got = Counter((r.doc_id, r.text, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in found.collect())
    assert got == Counter((d, t, tuple(library.encode(t or ""))) for d, t in rows)
    assert pieces.facts(found).filter("not round_trip").count() == 0
    assert pieces.encode(frame(spark, [])).count() == 0


def test_unigram_scan(tmp_path):
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    rng = random.Random(3)
    for piece in proto.pieces:
        piece.score = -float(rng.randrange(1, 1 << 16)) / 1024  # sums are exact
    library = SentencePieceProcessor(model_proto=proto.SerializeToString())
    (tmp_path / "uni.model").write_bytes(proto.SerializeToString())
    m = pieces.Model(str(tmp_path / "uni.model"))
    for _ in range(25):
        text = " ".join("".join(rng.choice("abetinhor") for _ in range(rng.randrange(1, 12))) for _ in range(30))
        line = pieces.BLANK + text.replace(" ", pieces.BLANK)

        def weight(ids):
            return sum(proto.pieces[i].score for i in ids)

        whole = np.frombuffer(m.words(line), "<u4").tolist()
        cuts = list(range(0, len(line), 70))
        cells = [{((a, b), (c, d)): w for a, b, c, d, w in pieces.transfer(m, line, s, min(s + 70, len(line)), s == 0)} for s in cuts]
        spans = pieces.hand_down(cells)
        ids = b"".join(pieces.chunk_ids(m, line, s, min(s + 70, len(line)), *span) for s, span in zip(cuts, spans))
        assert weight(library.encode(text)) == weight(whole) == weight(np.frombuffer(ids, "<u4").tolist())


def test_marks_after_letters_are_encoded_apart(tmp_path):
    """Word forms that differ in the marks at their end need no call of the tokenizer each; where it joins marks to letters, they stay whole."""
    from tokenizers import Tokenizer, pre_tokenizers

    path = packing.public_tokenizers.path("word_bpe_49k.json")
    encode, rng, calls = packing.encoder(path), random.Random(9), []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            calls.extend(texts)
            return library.encode_batch_fast(texts, **options)

        def __getattr__(self, name):
            return getattr(library, name)

    library, encode.tokenizer = encode.tokenizer, Counting()
    encode.known, encode.older = {}, {}
    stems = ["".join(rng.choice("abetinhoréßΣİक़日") for _ in range(rng.randrange(1, 9))) for _ in range(3000)] + ["don't", "a1", "e\u0301", "<|endoftext|>"]
    texts = [" ".join(rng.choice(stems) + rng.choice(["", ",", ".", "'", "!!", "</w>", "|>", "…", "'s", "'."]) for _ in range(400)) for _ in range(20)]
    try:
        assert [np.frombuffer(i, "<u4").tolist() for i in encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        calls.clear()
        plain = ["".join(p) for p in product("bcdfgh", repeat=4)]
        encode([" ".join(p + m for p in plain for m in (",", ".", "!?"))])
        assert len(calls) < 100
    finally:
        encode.tokenizer = library
    whole = Tokenizer.from_file(path)
    whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    whole.save(str(tmp_path / "whole.json"))
    other = packing.WordEncoder(str(tmp_path / "whole.json"))
    assert [np.frombuffer(i, "<u4").tolist() for i in other(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_forms_share_their_units(tmp_path, monkeypatch):
    """Capitals and marks make no new units to encode and remember; ids stay those of whole texts, by other rules and with little memory too."""
    from tokenizers import Tokenizer, normalizers

    path, rng = packing.public_tokenizers.path("word_bpe_49k.json"), random.Random(12)
    library, encode = Tokenizer.from_file(path), packing.WordEncoder(path)
    plain = ["".join(p) for p in product("bcdf", repeat=5)]
    encode([" ".join(plain)])
    held = len(encode.known)
    forms = " ".join(shape + m for p in plain for shape in (p.capitalize(), p.upper()) for m in ("", ",", "."))
    assert np.frombuffer(encode([forms])[0], "<u4").tolist() == library.encode(forms, add_special_tokens=False).ids
    assert len(encode.known) <= held + 3  # the two marks and nothing

    stems = ["".join(rng.choice("aHIKtsreÉßΣİĳǅक़日\u1100\u1161\u212a\u0331\u0307") for _ in range(rng.randrange(1, 7))) for _ in range(2000)]
    stems += ["H\u0331", "I\u0307", "Don't", "A1", "<|endoftext|>", "<|EndOfText|>", "a\x1cB", "A\x85b", "A\u00a0B", "A\u3000b", "ª", "x" * 5000]
    texts = ["", " ", "\t\n", " a", "A ", "!", "A."] + [
        "".join(rng.choice(stems) + rng.choice(["", ",", ".'", "'S", "…", "</w>"]) + rng.choice([" ", "  ", "\n", "\x0b\x0c\r"]) for _ in range(200)) for _ in range(30)]
    cased = Tokenizer.from_file(path)
    cased.normalizer = normalizers.NFC()
    cased.save(str(tmp_path / "cased.json"))
    lettered = Tokenizer.from_file(path)
    lettered.add_special_tokens(["HI"])
    lettered.save(str(tmp_path / "lettered.json"))
    for rules, file in ((library, path), (cased, str(tmp_path / "cased.json")), (lettered, str(tmp_path / "lettered.json"))):
        want = [rules.encode(t, add_special_tokens=False).ids for t in texts]
        for most in (packing.KNOWN_WORDS, 100, 0):
            monkeypatch.setattr(packing, "KNOWN_WORDS", most)
            encode = packing.WordEncoder(file)
            found = [i for at in range(0, len(texts), 5) for i in encode(texts[at:at + 5])]
            assert [np.frombuffer(i, "<u4").tolist() for i in found + encode(texts)] == want + want
        assert encode([]) == []


def test_new_word_forms_are_scanned_in_step(monkeypatch):
    """Forms that a batch holds for the first time need no Python loop each; only a few very long ones take it."""
    from sentencepiece import SentencePieceProcessor

    path = pieces.public_tokenizers.path("piece_bpe_32k.model")
    library, m, rng, alone = SentencePieceProcessor(model_file=path), pieces.Model(path), random.Random(8), []
    plain = m.unit
    monkeypatch.setattr(m, "unit", lambda text: alone.append(text) or plain(text))
    whole = sorted(m.ids)
    forms = ["".join(rng.choice("abetinhor.,é日🙂ß1") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    forms += ["".join(rng.choice(whole) for _ in range(rng.randrange(1, 6))) for _ in range(3000)] + [" " * n for n in range(40)]
    rng.shuffle(forms)
    texts = [" ".join(forms[i:i + 60]) for i in range(0, len(forms), 60)] + ["", "x" * 900, "日本語é" * 400]
    lines = [pieces.BLANK + t.replace(" ", pieces.BLANK) if t else "" for t in texts]
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(i, "<u4").tolist() for i in m.stretches(lines)] == [library.encode(t) for t in texts]
    assert 2 <= len(alone) < pieces.FEW and all(len(a) > pieces.ALWAYS for a in alone)
    ids = np.array([m.ids[p] for p in rng.choices(whole, k=4000)])
    pairs = np.concatenate([ids[:2000], ids[:2000]]), np.concatenate([ids[2000:], ids[2000:]])
    assert m.arrays.follows(*pairs).tolist() == [m.follows(library.id_to_piece(a), library.id_to_piece(b)) for a, b in zip(*map(np.ndarray.tolist, pairs))]

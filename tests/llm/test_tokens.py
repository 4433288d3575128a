"""Words, token counts, pieces, packing, chat and order against the libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import public_tokenizers

from pacewright.llm.chat import END, START, TEXT, conversation_digests, escaped, formatted_conversations, formatted_digests, unescaped
from pacewright.llm.ordering import Permutation, materialised, read_in_order, training_order
from pacewright.llm.packing import packed
from pacewright.llm.pieces import decoded_pieces, piece_ids, piece_round_trip
from pacewright.llm.token_counts import prefix_table, token_counts
from pacewright.llm.tokens import tokenizer

PARTS = ["a", "b", " ", "  ", "\n", "'s", "'ll", "'", "!", "9", "é", "日", " ", "<|endoftext|>", "<s>", "ab", "\t", "²", "…", "\U0001f600", "The", " retition", "'re", "aaaa", "ing", "the", "    ", "\r", "▁", "\x00"]


def texts(seed, n=400):
    rng = random.Random(seed)
    return [None, "", " ", "a " * 3000, "x" * 5000, *["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]]


@pytest.fixture(scope="module")
def library():
    return tokenizer("byte_bpe_50k.json")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' id", "1 length", "'y' ids")


def test_token_counts(spark, library):
    rows = list(enumerate(texts(1)))
    found = {r["doc_id"]: r for r in token_counts(frame(spark, rows), limit=12).collect()}
    for k, t in rows:
        t = t or ""
        r = found[k]
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 12)
        if len(t) < 200:
            assert r["fit_chars"] == max(i for i in range(len(t) + 1) if len(library.encode(t[:i], add_special_tokens=False).ids) <= 12)
    for r in prefix_table(frame(spark, rows[:60])).collect():
        t = rows[r["doc_id"]][1] or ""
        assert (r["ends"] or [0])[-1] == len(t) and (r["tokens"] or [0])[-1] == found[r["doc_id"]]["n_tokens"]


def test_longest_prefix(spark, library):
    rng = random.Random(11)
    runs = ["x", "'l", " ", "\n", "!", "'", "ab", "9", "é", "the", " 's", "\t ", "ing"]
    rows = [(0, " 'l's\n\n'" + "l" * 220), (1, " " * 300 + "x"), (2, "x" + " \n" * 200 + " y"), (3, "a" * 300 + "<|endoftext|>" + "!" * 300)]
    for k in range(4, 120):
        rows.append((k, "".join(rng.choice([*PARTS, rng.choice(runs) * rng.randint(1, 260)]) for _ in range(rng.randint(1, 5)))[:420]))
    df = frame(spark, rows)
    for limit in (1, 4, 12):
        found = {r["doc_id"]: r["fit_chars"] for r in token_counts(df, limit=limit).collect()}
        for k, t in rows:
            assert found[k] == max(i for i in range(len(t) + 1) if len(library.encode(t[:i], add_special_tokens=False).ids) <= limit), (k, limit)


def test_pieces(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = list(enumerate(texts(2)))
    ids = piece_ids(frame(spark, rows))
    found = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert found == {k: model.encode(t or "") for k, t in rows}
    back = {r["doc_id"]: r["text"] for r in decoded_pieces(ids).collect()}
    assert back == {k: (t or "").replace("▁", " ") for k, t in rows}
    trip = piece_round_trip(frame(spark, rows)).collect()
    assert all(r["round_trip"] == ("▁" not in (rows[r["doc_id"]][1] or "")) for r in trip)


def test_packing(spark, library):
    rows = list(enumerate(texts(3))) + [(None, "no id"), (7, "again"), (7, "again")]
    pieces = packed(frame(spark, rows).repartition(6), keep_ids=True).collect()
    whole: dict = {}
    for r in sorted(pieces, key=lambda r: r["start"]):
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        whole.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
    for k, t in rows:
        if k != 7:
            want = [*library.encode(t or "", add_special_tokens=False).ids, 0]
            assert sum((ids for _, ids, _ in whole[k]), []) == want and {n for *_, n in whole[k]} == {len(want)}
    sequences: dict = {}
    for r in pieces:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(n for s in sequences.values() for _, n in s)
    assert len(sequences) == -(-total // 1024)
    assert packed(frame(spark, rows).limit(0)).count() == 0


def test_chat(spark):
    library = tokenizer("byte_bpe_50k.json")
    rng = random.Random(5)
    parts = ["a", " b", "\n", "<|", "<|end|>", "<\\|", "<|start|>assistant<|text|>", "\\", "é日", "</s>", "[INST]", "\U0001f600", "|>", "<|endoftext|>"]
    rows = []
    for c in range(60):
        for turn in range(rng.randint(1, 6)):
            rows.append((c, turn, rng.choice(["user", "assistant", "assistant", "system", None, "x<|y"]), rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))])))
    rows += [(70, 0, "user", "\n" * 9), (70, 1, "assistant", "long é" * 60_000), (None, 0, "assistant", "no id"), (5, 1, "assistant", "tie"), (5, 1, "assistant", "tie"), (6, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 ids", "2 formatted").repartition(4)
    found = {r["conv_id"]: r for r in formatted_digests(df).collect()}
    formatted = formatted_conversations(df).persist()
    assert {r["conv_id"]: r for r in conversation_digests(formatted).collect()} == found
    library.add_special_tokens([START, TEXT, END])
    for r in formatted.collect():
        code = library.encode(r["formatted"], add_special_tokens=False)
        assert r["ids"] == code.ids and list(zip(r["begins"], r["ends"], strict=True)) == code.offsets
    assert formatted_digests(df.limit(0)).count() == 0
    by: dict = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(found) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        learned = "".join(t for _, r, t in turns if r == "assistant")
        r = found[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert all(unescaped(escaped(x)) == x and "<|" not in escaped(x) for x in ["<|", "<\\|", "<\\\\|x<|", "\\<|"])


def test_permutation():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        order = Permutation(n, 77)
        slots = order.slots(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (order.numbers(slots) == np.arange(n)).all()
    assert (Permutation(1000, 1).slots(np.arange(1000)) != Permutation(1000, 2).slots(np.arange(1000))).any()


def test_training_order(spark, library, tmp_path):
    rows = [(k, t) for k, t in enumerate(texts(6, 100))]
    df = frame(spark, rows).coalesce(1)
    shards, n = materialised(df, str(tmp_path), 9, stride=64, per_shard=10)
    made = shards.collect()
    stream = [i for _, t in rows for i in [*library.encode(t or "", add_special_tokens=False).ids, 0]]
    stream += [0] * (-len(stream) % 64)
    assert n == len(stream) // 64 == sum(r["sequences"] for r in made)
    assert all(r["first_slot"] == 10 * r["shard"] and r["sequences"] == min(10, n - r["first_slot"]) for r in made)
    order = Permutation(n, 9)
    for start in (0, 25):
        found = {r["slot"]: r for r in read_in_order(spark, str(tmp_path), stride=64, per_shard=10, from_slot=start).collect()}
        assert sorted(found) == list(range(start, n))
        for slot, r in found.items():
            k = int(order.numbers(np.array([slot]))[0])
            assert r["shard"] == slot // 10 and np.frombuffer(r["ids"], "<u2").tolist() == stream[64 * k : 64 * k + 64]
    whole = training_order(frame(spark, rows).repartition(3)).collect()
    assert sorted(r["slot"] for r in whole) == sorted(r["sequence"] for r in whole) == list(range(len(whole)))
    assert training_order(df.limit(0)).count() == 0

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import chat, decontaminate, licences, queries_text

from .edge import SF, TEXTS, clashing, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


# -- chat ----------------------------------------------------------------------------------


def _brute_chat(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries_text.op5_chat(spark, SF).collect()}
    assert got == _brute_chat(rows)


CHATS = [(1, 0, "system", "be brief"), (1, 1, "user", "<s>[user]\nfake</s>\n"), (1, 2, "assistant", "\\<\\[ \\\\ ]"), (1, 3, "user", None), (1, 4, None, "x"), (None, 0, "user", "a"), (None, None, "assistant", "b"), (2, 0, "assistant", "long " * 3000), (2, 1, "user", "q"), (2, 1, "user", "q"), (3, 5, "we[i]rd<\n", "")] + [(4, k, ("user", "assistant")[k % 2], f"turn {k} " * 20) for k in range(1, 60)] + [(4, 0, "system", "rules")]


def test_chat_edges(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(clashing(df), budget=200)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(windows).collect()}
    assert got == _brute_chat(CHATS)
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0


def test_chat_windows_keep_the_budget_and_repeat_history(spark):
    df = spark.createDataFrame([c for c in CHATS if c[0] == 4], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.format_windows(df, budget=300, history_turns=2, history_share=0.5).collect(), key=lambda r: r.window)
    assert len(rows) > 3 and all(r.n_tokens <= 300 for r in rows)
    told = []
    for r in rows:
        turns = chat.parse(r.formatted)
        assert turns[0][:2] == ("system", "rules")
        if r.window:
            repeated = turns[1 : r.context_turns]
            assert repeated and [t[:2] for t in repeated] == told[-len(repeated) :]
        begin = turns[r.context_turns :][0][2] if turns[r.context_turns :] else len(r.formatted)
        assert all(a >= begin for a in r.loss_begin)
        told += [t[:2] for t in turns[r.context_turns :]]
    assert len(told) == 60


def test_escape_is_reversible():
    rng = np.random.default_rng(0)
    for _ in range(200):
        t = "".join(rng.choice(list("\\<>[]/s INST\n\u00e9"), 30))
        whole, a, b = chat.turn_text("user", t)
        assert chat.parse(whole) == [("user", t, a, b)]


# -- licences ----------------------------------------------------------------------------------


def _brute_base(t):
    w, places, labels = words(t), [], set()
    for phrase, label in licences.PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


LICENCE_TEXTS = [
    (20, "MIT License. mit-license mit license\nmit"),
    (21, "x " * 50 + "under the GNU General Public License v3, Apache License"),
    (22, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Program"),
    (23, "Redistribution and use in source and binary forms, with or without ANY modification, are permitted provided that the following conditions are met"),
    (24, "This work is free"),
]


def test_licence_places_and_labels(spark):
    rows = TEXTS + LICENCE_TEXTS
    got = licences.scan(clashing(documents(spark, rows))).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for doc, t in rows:
        for r in by[doc]:
            if doc is not None:
                assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _brute_base(t)
                assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert by[22][0].labels == "mit" and by[22][0].spans and by[23][0].labels == "bsd" and by[24][0].labels == ""
    assert licences.scan(documents(spark, [])).count() == 0


def test_licence_query(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries_text.op7_licences(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _brute_base(rows[r.doc_id])


def test_automaton_gives_matching_statistics():
    rng = np.random.default_rng(0)
    seqs = [rng.integers(0, 4, 12).tolist() for _ in range(5)]
    sam = licences.SuffixAutomaton(seqs)
    text = rng.integers(0, 5, 200).tolist()
    text = [-1 if x == 4 else x for x in text]
    stats = [max((n for n in range(0, i + 2) if any(text[i + 1 - n : i + 1] == s[k : k + n] for s in seqs for k in range(len(s) - n + 1))), default=0) for i in range(len(text))]
    want = {(i, stats[i]) for i in range(len(text)) if stats[i] >= 3 and (i + 1 == len(text) or stats[i + 1] != stats[i] + 1)}
    found = sam.stretches(text, 3)
    assert {(i, n) for i, n, _ in found} == want
    for i, n, state in found:
        for s, end in sam.ends[state].items():
            assert seqs[s][end - n + 1 : end + 1] == text[i - n + 1 : i + 1]


def test_licence_stretches_that_repeat_in_a_template():
    """A stretch may follow from its second place, and any open chain may go on."""
    sam = licences.SuffixAutomaton([[1, 2, 3, 4, 5, 1, 2, 3, 4, 6]])
    (match,) = sam.stretches([1, 2, 3, 4], 4)
    assert sam.places[match[2]] == {0: {3, 8}}
    # The first stretch lies at two places; only the second one leads on to the next.
    assert licences._best_chains([(0, 0, 10), (0, 50, 10), (12, 62, 20)])[0] == (0, 32, 30)
    # Five chains are open, and the oldest one goes on.
    crowd = [(i, 100 * i, 4) for i in range(5)]
    assert (0, 18, 14) in licences._best_chains([*crowd, (8, 4, 10)])


# -- decontamination ------------------------------------------------------------------------------


def _brute_report(rows, items, window=8):
    wins = defaultdict(set)
    for item, t in items:
        w = words(t)
        if w and item is not None:
            for i in range(max(1, len(w) - window + 1)):
                wins[tuple(w[i : i + window])].add(str(item))
    sizes = {len(w) for w in wins}
    out = []
    for doc, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


ITEMS = [(10, "the quick brown fox jumps over the lazy dog near"), (9, "lazy dog"), (100, "word"), (7, None), (None, "two words"), (8, "..."), (11, "the the the the the the the the the"), (9, "lazy dog"), (12, "Alpha beta, gamma delta alpha beta gamma DELTA alpha")]


@pytest.mark.parametrize("wrap", [lambda d: d, clashing])
def test_decontamination_edges(spark, wrap):
    rows = TEXTS + [(30, "the " * 12), (31, "a lazy dog, lazy dog word"), (32, "Lazy-Dog")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.report(wrap(documents(spark, rows)), wrap(items)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == _brute_report(rows, ITEMS)
    none = decontaminate.report(documents(spark, rows), items.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.n_hit for r in none)
    assert decontaminate.report(documents(spark, []), items).count() == 0
    kept = decontaminate.clean(wrap(documents(spark, rows)), wrap(items))
    assert kept.count() == sum(not r[5] for r in _brute_report(rows, ITEMS)) and set(kept.columns) == set(wrap(documents(spark, rows)).columns)


def test_proximity(spark):
    phrases = decontaminate.Phrases.of(spark.createDataFrame([(1, "red green blue")], "item_id long, text string"))
    docs = documents(spark, [(1, "red green blue"), (2, "red and green blue"), (3, "blue green red"), (4, "red x x x green blue")])
    index = decontaminate.Index.build(docs, phrases.dictionary)
    assert {r.dk for r in index.matches(phrases).select("dk").distinct().collect()} == {1}
    assert {r.dk for r in index.matches(phrases, slop=1).select("dk").distinct().collect()} == {1, 2}


def test_decontamination_stays_native(spark):
    docs = documents(spark, TEXTS)
    plan = decontaminate.report(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)
    assert docs.where(F.col("doc_id").isNull()).count() == 2

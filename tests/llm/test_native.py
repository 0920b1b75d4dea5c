"""Decontamination, sharding, archives, chats and mixes."""

import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from loglantern.llm import chat, decontaminate, mixing, sharding, warc


# --- decontamination ---------------------------------------------------------------------
def items_and_documents():
    pick = random.Random(8)
    words = [f"v{n}" for n in range(3000)]
    items = [[pick.choice(words) for _ in range(n)] for n in (14, 20, 20, 36, 59, 59, 3, 1)]
    docs, planted = [], {}
    for n in range(200):
        own = [pick.choice(words) for _ in range(pick.randint(60, 150))]
        at = pick.randint(0, len(own))
        if n % 4 == 0:
            item = n // 4 % len(items)
            held = list(items[item])
            if n % 8 == 0 and len(held) > 50:
                held[len(held) // 2] = "changed"
            text = " ".join(own[:at] + held + own[at:])
            planted[n] = item
            docs.append((n, text.upper() + " !!!" if n % 3 else text))
        elif n % 4 == 1:
            docs.append((n, " ".join(own[:at] + items[4][:25] + own[at:])))  # a part of an item
        else:
            docs.append((n, " ".join(own)))
    return list(enumerate(" ".join(i) for i in items)), docs, planted


@pytest.mark.parametrize("most_broadcast", [1_000_000, 40])
def test_planted_items_are_found_and_no_others(spark, most_broadcast):
    items, docs, planted = items_and_documents()
    bench = spark.createDataFrame([*items, (90, None), (91, " !! "), (92, items[0][1])], "item_id long, text string")
    frame = spark.createDataFrame([*docs, (900, None), (901, ""), (902, items[3][1])], "doc_id long, text string")
    rows = decontaminate.leaks(frame, bench, most_broadcast=most_broadcast).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    expected = {(d, i) for d, i in planted.items()} | {(902, 3)} | {(d, 92) for d, i in planted.items() if i == 0}
    assert expected <= found
    own = {i: set(t.split()) for i, t in items}
    texts = dict(docs)
    for d, i in found - expected:  # short items occur by chance
        assert len(own[i]) < 5 and own[i] <= set(texts[d].lower().split())
    assert all(r.similarity == 1 for r in rows if planted.get(r.doc_id) == r.item_id and len(own[r.item_id]) < 50)


def test_fingerprints_and_blocks(spark):
    pick = random.Random(9)
    rows = [(n, [f"w{pick.randrange(40)}" for _ in range(30)]) for n in range(60)]
    frame = spark.createDataFrame(rows, "item_id long, words array<string>").withColumn("length", F.lit(30))
    hashed = frame.withColumns({"print": decontaminate.fingerprint(F.col("words")), "shingles": decontaminate.shingles(F.col("words")),
        "h": F.transform("words", lambda w: F.xxhash64(w))})
    told = hashed.collect()
    for r in told:
        plain = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in r.h) > len(r.h))
        assert r["print"] % (1 << 64) == plain
    assert sum(w for _, w in decontaminate.block_spans()) == 64
    near = decontaminate.candidates(hashed.select("words", F.col("item_id").alias("doc_id"), "length"), hashed, radius=11)
    met = {(r.doc_id, r.item_id) for r in near.collect()}
    by_id = {r.item_id: r["print"] for r in told}
    assert met == {(a, b) for a in by_id for b in by_id if bin((by_id[a] ^ by_id[b]) % (1 << 64)).count("1") <= 11}
    assert near.count() == len(met)


def test_items_that_lack_an_end_are_found(spark):
    """Every window of similarity 0.8 to 0.9 is found, also those whose fingerprints are far from the item's."""
    pick = random.Random(14)
    words = [f"u{n}" for n in range(5000)]
    items = [[pick.choice(words) for _ in range(pick.randint(30, 90))] for _ in range(40)]
    docs, expected = [], {}
    for n in range(400):
        item = items[n % 40]
        shingled = len(item) - 4
        lost = next(k for k in range(shingled // 9, 0, -1) if (shingled - k) / (shingled + k) >= 0.8)
        lost = lost if n % 3 else pick.randint(-(-shingled // 19), lost)
        other = [pick.choice(words) for _ in range(lost)] if n % 5 else [pick.choice(words)] * lost
        held = item[:-lost] + other if n % 2 else other + item[lost:]
        docs.append((n, " ".join([pick.choice(words) for _ in range(20)] + held + [pick.choice(words) for _ in range(20)])))
        expected[n, n % 40] = round((shingled - lost) / (shingled + lost), 9)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rows = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert 0.8 <= min(expected.values()) < 0.82
    found = {(r.doc_id, r.item_id): r.similarity for r in rows}
    assert found.keys() == expected.keys()
    assert all(found[p] >= s - 1e-9 for p, s in expected.items())


def test_clean_keeps_the_rest_whole(spark, odd_documents, no_documents):
    bench = spark.createDataFrame([(1, "nothing like it at all here"), (2, "short one")], "item_id long, text string")
    kept = decontaminate.clean(odd_documents, bench)
    assert kept.columns == odd_documents.columns
    assert kept.count() == odd_documents.count() - 2 and not {8, 9} & {r.doc_id for r in kept.collect()}
    assert decontaminate.clean(no_documents, bench).count() == 0
    assert decontaminate.clean(odd_documents, bench.where("false")).count() == odd_documents.count()


# --- sharding ----------------------------------------------------------------------------
@pytest.mark.parametrize("sizes", [[1] * 300, [2] * 150, [100] + [3] * 60 + [1] * 50, [5]])
def test_shards_hold_equal_rows_and_linked_ones_meet(spark, sizes):
    rows = [(n, f"text {g}") for n, g in enumerate(g for g, size in enumerate(sizes) for _ in range(size))]
    out = sharding.shard_texts(spark.createDataFrame(rows, "doc_id long, text string"), shards=7).collect()
    counts = [sum(r.shard == s for r in out) for s in range(7)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    for s in range(7):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    places = {}
    for r in out:
        places.setdefault(r.text_crc32, []).append(r.shard)
    apart = sum(len(p) - max(p.count(s) for s in p) for p in places.values())
    by_chance = sum(len(p) * 6 / 7 for p in places.values() if len(p) > 1) * 0.6
    oversize = sum(max(0, size - len(rows) // 7) for size in sizes)
    assert apart <= max(by_chance * 0.5, 2) + oversize


def test_a_group_larger_than_a_shard_fills_several(spark):
    """A third of all rows in one group, and pairs beside it: both meet as far as shards have room."""
    sizes = [320] + [2] * 60 + [1] * 520
    rows = [(n, f"text {g}") for n, g in enumerate(g for g, size in enumerate(sizes) for _ in range(size))]
    slim = sharding.documents(spark.createDataFrame(rows, "doc_id long, text string"))
    links = sharding.text_links(slim)
    out = sharding.shard(slim, links, shards=8).collect()
    counts = [sum(r.shard == s for r in out) for s in range(8)]
    assert counts == [120] * 8
    by_text = {}
    for r in out:
        by_text.setdefault(r.group, []).append(r.shard)
    hot = next(p for p in by_text.values() if len(p) == 320)
    together = sum(hot.count(s) ** 2 for s in range(8)) / 320**2
    assert together >= 0.3  # 0.34 with two full shards and the rest in a third, 0.125 by chance
    pairs = [p for p in by_text.values() if len(p) == 2]
    assert sum(a == b for a, b in pairs) >= 50


def test_links_of_any_kind(spark):
    """Two rings of linked documents end in fewer shards than chance would put them in."""
    slim = spark.range(60).select(F.col("id").alias("row"), F.xxhash64("id").alias("order"))
    edges = [(n, f"e{n}") for n in range(60)] + [((n + 1) % 30 + 30 * (n // 30), f"e{n}") for n in range(60)]
    links = spark.createDataFrame(edges, "row long, group string")
    state = sharding.propagate(slim, links, 60, shards=4, rounds=6)
    counts = {r.shard: r["count"] for r in state.groupBy("shard").count().collect()}
    assert max(counts.values()) <= 15 and sum(counts.values()) == 60
    cut = sharding.cut_share(state, links).first()
    assert cut.linked == 120 and cut.apart < 45


def test_quotas_are_swaps_and_free_rows_by_demand():
    """Shard 0 has 3 free rows and 2 that leave for 1, 1 none, 2 one; loads stay within shares of 12, 12 and 11 rows."""
    asked = {(1, 0): 5, (2, 0): 4, (0, 1): 2, (1, 2): 3}
    got = sharding._quotas(asked, [9, 12, 10], 35)
    assert got == {(1, 0): 3, (2, 0): 2, (0, 1): 2, (1, 2): 1}
    assert sharding._quotas({}, [9, 12, 10], 35) == {}


def jobs(spark, work) -> int:
    """How many Spark jobs it takes; each shuffle and each broadcast is one at least, and a thread of the driver."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_of_sharding_are_few(spark):
    """Rounds in which many move: a driver keeps threads and native memory for each shuffle and broadcast."""
    rows = [(n, f"text {n % 60}" if n % 3 else f"own {n}") for n in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").localCheckpoint()
    assert jobs(spark, lambda: sharding.shard_documents(docs, shards=6).collect()) <= 110  # 134 before


def test_odd_rows_are_sharded(spark, odd_documents, no_documents):
    rows = sharding.shard_texts(odd_documents).collect()
    assert len(rows) == odd_documents.count() and {r.size for r in rows if r.doc_id in (3, 4)} == {8}
    assert [r.text_crc32 for r in rows if r.doc_id == 3] == [None]
    assert sharding.shard_texts(no_documents).count() == 0


# --- archives -----------------------------------------------------------------------------
HTML = """<HTML><head><title> A &amp; B </title><script>var t="</p>"; x<y</script><STYLE>p{}</style></head>
<!-- hidden <p> --><body><nav><a href="/one">1</a></nav><p>First&nbsp;&lt;line&gt;<br>two &#233;&#x41;&#0000233; &unknown; &#99999999; &#xD800; &#38;lt; &amp;amp; &</p><a class=x href=/two>2</a>
text &amp;lt; <b>bold</b> 3 < 4<script>open"""


def test_text_and_links(spark):
    pages = spark.createDataFrame([(1, "http://a/", HTML), (2, None, None), (3, "u", ""), (3, "u", "")], "page_id long, url string, html string")
    rows = warc.derivatives(warc.responses(pages.withColumn("block", F.lit("clash")), "2024-01-01T00:00:00Z")).collect()
    by = {(r.page_id, r.warc_type): r for r in rows}
    assert len(rows) == 8
    text = by[1, "conversion"].block
    assert text == "A & B\n1\nFirst <line>\ntwo éAé &unknown; &#99999999; &#xD800; &lt; &amp; &\n2 text &lt; bold 3 < 4"
    assert "outlink: /one\r\noutlink: /two\r\n" in by[1, "metadata"].block and "title: A & B\r\n" in by[1, "metadata"].block
    assert by[2, "conversion"].block == "" and "WARC-Target-URI" not in by[2, "conversion"].header
    assert by[1, "metadata"].refers_to == by[1, "conversion"].refers_to != by[1, "conversion"].record_id
    import base64

    for r in rows:
        plain = base64.b32encode(hashlib.sha1(r.block.encode()).digest()).decode()
        assert r.block_digest == "sha1:" + plain and r.content_length == len(r.block.encode())
    assert by[3, "conversion"].source_payload_digest == by[3, "conversion"].block_digest
    assert warc.derivatives(warc.responses(pages.where("false"), "d")).count() == 0


def test_serialised_records_come_back(spark):
    pages = spark.createDataFrame([(1, "http://a/", HTML), (2, None, None)], "page_id long, url string, html string")
    made = warc.derivatives(warc.responses(pages, "2024-01-01T00:00:00Z"))
    columns = ["page_id", "warc_type", "record_id", "refers_to", "target_uri", "block_digest", "block"]
    back = warc.parsed(warc.serialised(made)).select(*columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, made.select(*columns).collect()))


# --- chats ----------------------------------------------------------------------------------
def test_chats_come_back_whole(spark):
    pick = random.Random(12)
    bits = ["<", "[", "\\", "|im_end|>", "<|im_start|>", "<|im_sep|>", "</s>", "<s>", "[INST]", "[/INST]", "\n", "<<SYS>>", "é", "plain", "$1", ""]
    rows, told = [], {}
    for conv in range(150):
        turns = []
        for turn in range(pick.randint(1, 7)):
            role = pick.choice(["user", "assistant", "assistant", "system", "odd\nrole\\n", ""])
            text = "".join(pick.choice(bits) for _ in range(pick.randint(0, 9)))
            turns.append((role, text))
            rows.append((conv, turn, role or None, text or None, "x"))
        told[conv] = turns
    pick.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    shaped = chat.formatted(frame)
    back = {r.conv_id: r for r in chat.read_back(shaped).collect()}
    digests = {r.conv_id: r for r in chat.digests(chat.read_back(shaped)).collect()}
    for conv, turns in told.items():
        assert [(t.role, t.text) for t in back[conv].turns] == turns
        loss = "".join(t for r, t in turns if r == "assistant")
        assert back[conv].loss_text == loss
        assert digests[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and digests[conv].n_turns == len(turns)
    whole = {r.conv_id: r.formatted for r in shaped.collect()}
    runs = {c: 1 + sum(a[0] != b[0] for a, b in zip(t, t[1:], strict=False)) for c, t in told.items()}
    assert all(whole[c].count(chat.OPEN) == runs[c] == whole[c].count(chat.CLOSE) for c in told)


def test_odd_chats(spark):
    rows = [(None, 1, "user", "a"), (None, None, "user", "first"), (1, 1, "assistant", None), (1, 1, "assistant", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.formatted(frame)).collect()}
    assert back == {None: [("user", "first"), ("user", "a")], 1: [("assistant", ""), ("assistant", "")]}
    assert chat.formatted(frame.where("false")).count() == 0


# --- mixes ----------------------------------------------------------------------------------
def shares(sizes, weights, share=1.5, repeats=2):
    """Targets by sharing the excess again until no source is above its limit."""
    left, wanted, out = dict(sizes), share * sum(sizes.values()), {}
    while left:
        total = sum(weights[s] for s in left)
        over = [s for s in left if wanted * weights[s] / total > repeats * left[s]]
        if not over:
            return out | {s: wanted * weights[s] / total for s in left}
        for s in over:
            out[s] = repeats * left.pop(s)
            wanted -= out[s]
    return out


@pytest.mark.parametrize("block", [256, 7])
def test_targets_and_words_taken(spark, block):
    pick = random.Random(6)
    names = ["b", "a", "ä", "Z", None, "c", "only blanks"]
    rows = [(n, " ".join(["w"] * pick.randint(0, 200)) if n % 50 else None, pick.choice(names[:6])) for n in range(400)]
    rows += [(1000, "w " * 9000, "a"), (1001, " ", "only blanks"), (1001, " ", "only blanks"), (7, rows[7][1], rows[7][2])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "target": F.lit(1), "key": F.lit(0)})
    got = mixing.mix(frame, block=block).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    expected = shares(sizes, weights)
    for s in order:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - expected[s]) < 1e-6 and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - expected[s]) <= 1
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    again = mixing.mix(frame.repartition(5), block=block).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in got if r.doc_id != 7) == sorted((r.doc_id, r.size, r.taken) for r in again if r.doc_id != 7)


def test_the_schedule_is_even(spark):
    plan = spark.createDataFrame([("a", 0, 500), ("b", 1, 250), ("c", 2, 250)], "key string, rank int, slots long")
    slots = [r.key for r in mixing.schedule(plan).orderBy("slot").collect()]
    assert len(slots) == 1000
    for n in (50, 200, 800):
        assert abs(slots[:n].count("a") - n / 2) <= 4 and abs(slots[:n].count("c") - n / 4) <= 4
    turns = mixing.schedule(plan).collect()
    for key, n in (("a", 500), ("b", 250), ("c", 250)):
        assert sorted(r.turn for r in turns if r.key == key) == list(range(n))


def test_the_sequence_spells_the_mix(spark):
    """Every slot takes at most a block of its source's next words; what it takes adds up to the mix."""
    pick = random.Random(9)
    rows = [(n, " ".join(["w"] * pick.randint(0, 90)), pick.choice("aabc")) for n in range(300)] + [(300, "w " * 3000, "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = mixing.sequence(frame, block=16).orderBy("slot", "place").collect()
    mixed = {r.doc_id: r for r in mixing.mix(frame, block=16).collect()}
    sizes, taken, first, used = {n: len(t.split()) for n, t, _ in rows}, {}, {}, {}
    for r in told:
        assert 0 <= r.first_word and r.words > 0 and r.first_word + r.words <= sizes[r.doc_id]
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.words
        first.setdefault(r.doc_id, r.slot)
        used.setdefault(r.slot, []).append(r)
    assert all(mixed[n].taken == taken.get(n, 0) and mixed[n].first_slot == first.get(n) for n in sizes)
    assert all(len({r.source for r in own}) == 1 and sum(r.words for r in own) <= 16 for own in used.values())
    # any part of the mix has the sources in the shares of the whole
    want = {s: sum(r.taken for r in mixed.values() if r.source == s) for s in "abc"}
    for part in (0.25, 0.5, 0.75):
        some = [r for r in told if r.slot < part * len(used)]
        for s in "abc":
            assert abs(sum(r.words for r in some if r.source == s) - part * want[s]) <= 0.02 * sum(want.values())
    # a source is gone through once before it repeats
    places = [r.place for r in told if r.source == "b"]
    turn = places.index(0, 1) if 0 in places[1:] else len(places)
    assert places[:turn] == sorted(places[:turn])


def test_no_sources_and_one(spark):
    frame = spark.createDataFrame([(1, "a b c", None)], "doc_id long, text string, source string")
    # the target of 4.5 words is met by five
    assert [(r.slot, r.doc_id, r.words) for r in mixing.sequence(frame).orderBy("slot").collect()] == [(0, 1, 3), (1, 1, 2)]
    assert mixing.sequence(frame.where("false")).count() == 0


def test_whole_shards_keep_columns_and_repeats(spark, odd_documents, no_documents):
    """Each row of the documents, repeats included, has a shard and slot of its own."""
    clash = odd_documents.withColumns({"slot": F.lit("mine"), "_row": F.lit(5)})
    got = sharding.shard_documents(clash, shards=3).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(r.doc_id), str(r.text)) for r in odd_documents.collect())
    assert len({(r.shard, r.slot) for r in got}) == len(got) and all(r._row == 5 for r in got)
    assert sharding.shard_documents(no_documents).count() == 0


def test_whole_documents_of_a_mix(spark, odd_documents, no_documents):
    odd_documents = odd_documents.withColumns({c: F.lit(c) for c in ("_same", "_times", "_copy")})
    no_documents = no_documents.withColumns({c: F.lit(c) for c in ("_same", "_times", "_copy")})
    kept = mixing.mixed(odd_documents)
    assert kept.columns == odd_documents.columns
    assert kept.where("_same = '_same' and _times = '_times' and _copy = '_copy'").count() == kept.count()
    ids = {r.doc_id for r in kept.collect()}
    assert not {3, 4, 5} & ids and 6 in ids
    assert mixing.mixed(no_documents).count() == 0 and mixing.mix(no_documents).count() == 0

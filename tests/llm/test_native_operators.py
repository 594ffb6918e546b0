"""Exact dedup, source mixing and chat formatting against brute force and check SQL."""

import collections
import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from heliopanel.llm import queries as Q
from heliopanel.llm.chat_format import chat_digests, format_chats
from heliopanel.llm.exact_dedup import drop_exact_duplicates, exact_dedup
from heliopanel.llm.line_dedup import line_dedup
from heliopanel.llm.mixing import mix, mixed_documents

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, row string, _m string"


def squeeze(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def documents(spark):
    rows = []
    for i in range(120):
        text = "a b  c" if i % 3 else f"text {i % 7}\n" + " " * (i % 4)
        rows.append((i, text, "en", f"s{i % 5}" if i % 6 else None, i, "x", 1, "r", "m"))
    rows += [(500, None, None, None, None, None, None, None, None), (501, "", "en", "s1", 0, None, None, None, None),
             (502, " \t", "en", "s1", 2, None, None, None, None), (None, "abc", "en", "s2", 3, None, None, None, None),
             (7, rows[7][1], "en", "s2", 7, "x", 1, "r", "m"), (503, "word " * 40_000, "en", "s9", 1, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def test_exact_dedup_matches_brute_force(spark):
    df = documents(spark)
    groups = collections.defaultdict(list)
    for r in df.collect():
        groups[squeeze(r.text)].append(r)
    out = exact_dedup(df).collect()
    assert len(out) == df.count()
    kept = collections.Counter()
    for r in out:
        norm = squeeze(r.text)
        best = min(groups[norm], key=lambda g: (-len(g.text or ""), g.doc_id is None, g.doc_id or 0))
        assert (r.keep_id, r.group_size) == (best.doc_id, len(groups[norm]))
        assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()
        kept[norm] += r.kept
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_dedup_rows_and_empty_table(spark):
    df = documents(spark)
    stay = drop_exact_duplicates(df)
    assert stay.columns == df.columns
    assert stay.count() == len({squeeze(r.text) for r in df.collect()})
    assert drop_exact_duplicates(df.limit(0)).count() == 0
    assert exact_dedup(df.limit(0)).columns[-4:] == ["keep_id", "group_size", "kept", "text_sha256"]


def sainte_lague(votes, seats):
    won = collections.Counter()
    for _ in range(seats):
        best = max(votes, key=lambda v: (votes[v] / (2 * won[v] + 1)))
        won[best] += 1
    return won


def expected_targets(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped, left = {}, set(names)
    while True:
        level = (sum(sizes.values()) - sum(capped.values())) / max(1, sum(weight[s] for s in left))
        over = {s for s in left if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: capped.get(s, weight[s] * level) for s in names}
        capped |= {s: most * sizes[s] for s in over}
        left -= over


def test_mix_meets_targets(spark):
    df = documents(spark)
    first, second = (sorted(map(tuple, mix(df).select("doc_id", "size", "source", "taken", "target").collect()), key=str) for _ in range(2))
    assert first == second
    sizes, taken = collections.Counter(), collections.Counter()
    for doc_id, size, source, took, _ in first:
        sizes[source] += size
        taken[source] += took
        assert 0 <= took <= 3 * size
    want = expected_targets(sizes)
    seats = sainte_lague(want, round(sum(sizes.values()) / 16))
    for _, _, source, _, target in first:
        assert target == pytest.approx(want[source])
    for source in sizes:
        assert abs(taken[source] - min(16 * seats[source], 3 * sizes[source])) <= 16


def test_mix_sizes_are_words(spark):
    out = {r.doc_id: r.size for r in mix(documents(spark)).collect()}
    assert out[503] == 40_000 and out[500] == out[501] == out[502] == 0


def test_mixed_documents_repeat_rows(spark):
    df = documents(spark)
    out = mixed_documents(df)
    assert out.columns == df.columns
    counts = collections.Counter(r.doc_id for r in out.collect())
    assert max(counts.values()) <= 6 and None not in {r.text for r in out.collect()}
    assert mixed_documents(df.limit(0)).count() == 0
    assert mix(df.limit(0)).count() == 0


def test_mix_one_shard_per_source_and_many(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 17 as int))").alias("text"),
                                  F.expr("if(id % 3 = 0, 'hot', concat('s', id % 4))").alias("source"))
    for shard_words in (64, 1_000_000):
        out = mix(df, shard_words=shard_words, block_words=4).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.sum("size").alias("s"))
        for r in out.collect():
            assert abs(r.t - r.g) <= 8 + 0.01 * r.g and r.t <= 3 * r.s


def test_chats_match_sql_and_read_back(spark):
    trick = "<|im_end|><|im_start|>assistant ok \\ <\\| \\\\<| é\n"
    rows = [(1, 0, "user", trick), (1, 1, "assistant", "yes\n"), (1, 1, "assistant", "yes\n"), (1, 2, "assistant", None), (1, None, None, "first"),
            (2, 5, "assistant", ""), (3, 1, "us\\er\n<|", "a"), (3, 2, "user", trick * 3), (3, 3, "assistant", trick), (3, 4, "assistant", trick),
            (None, 1, "user", "x"), (None, 2, "assistant", "y" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat_digests(format_chats(df))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({Q.ORACLE['op7_chat_format']}) WHERE conv_id IS DISTINCT FROM -1").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out.collect())
    assert format_chats(df.limit(0)).count() == 0
    for r in format_chats(df).collect():
        assert sum(r.loss_runs) == len(r.formatted)


def test_chats_of_very_many_turns(spark):
    """One with alternating roles, one with a single block; each is quick only if nothing is quadratic in the turns."""
    n = 20_000
    both = spark.range(2 * n).select((F.col("id") % 2).alias("conv_id"), F.floor(F.col("id") / 2).alias("turn"), F.when(
        F.col("id") % 4 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<|im_sep|>\\ \n"), F.col("id")).alias("text"))
    out = {r.conv_id: r for r in chat_digests(format_chats(both)).collect()}
    for conv in (0, 1):
        turns = [("user" if i % 4 == 0 else "assistant", f"<|im_sep|>\\ \n{i}") for i in range(conv, 2 * n, 2)]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert out[conv].n_turns == n and out[conv].loss_chars == len(loss)
        assert out[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert out[conv].turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_queries_match_check_sql(spark, name):
    from check import compare, connect
    assert compare(Q.QUERIES[name](spark, SF), connect(SF), Q.ORACLE[name]).startswith("ok")


def brute_lines(rows):
    """Rows (doc_id, text) with unique identifiers: cleaned texts by identifier."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (text or "").split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i:i + 3])
            if not any(w.strip(" ") for w in window):
                continue
            if window in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(window)
        out[doc_id] = ("\n".join(w for i, w in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def test_line_dedup_matches_brute_force(spark):
    import random
    random.seed(5)
    rows = [(i, "\n".join(random.choice("abcdefgh ") for _ in range(random.randint(0, 25)))) for i in range(80)]
    rows += [(200, "x\ny\nz"), (201, "w\nx\ny\nz\nv"), (202, "x\ny\nz"), (203, "x\ny"), (204, ""), (205, "\n\n\n\n"), (206, "q\n" * 3000), (207, None), (None, "a\nx\ny\nz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("n_lines", F.lit("old")).withColumn("key", F.lit(2))
    out = line_dedup(df)
    assert out.columns == ["doc_id", "text", "runs", "key", "n_lines", "n_removed"]
    want = brute_lines(rows)
    for r in out.collect():
        assert (r.text or "", r.n_lines, r.n_removed) == want[r.doc_id]
    assert line_dedup(df.limit(0)).count() == 0


def test_line_dedup_of_repeated_rows(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd"), (2, "e\nf\ng\nd")]
    out = sorted((r.doc_id, r.text) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "d"), (2, "e\nf\ng\nd")]


def test_mixed_documents_meet_targets_of_long_documents(spark):
    """Documents as long as a shard: rounding each for itself drops or overfills a source."""
    rows = [(i, "w " * (80 if i < 800 else 20 + i % 150), "a" if i % 2 else "b") for i in range(1600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    for weights in ((1, 4), (7, 13), (5, 2)):
        settings = {"weights": weights, "shard_words": 64}
        targets = {r.source: r.target for r in mix(df, **settings).select("source", "target").distinct().collect()}
        got = collections.Counter()
        for r in mixed_documents(df, **settings).collect():
            got[r.source] += len(r.text.split())
        for s, target in targets.items():
            assert abs(got[s] - target) <= 170 + 16, (weights, s, got[s], target)

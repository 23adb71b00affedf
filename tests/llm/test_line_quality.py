"""Quality rules against plain Python, boilerplate by host, edge cases, and the SQL of the query."""

import re

import pytest

from spendframe.llm import line_quality as lq
from spendframe.llm.oracles import oracle_sql
from spendframe.llm.queries import op8_line_quality, op10_perspectives
from workload.check import connect, plain, sort_key

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


def unique(k, n=60):
    return " ".join(f"w{k}x{i}" for i in range(n))


def test_measures(texts):
    rows = [
        (1, unique(1)), (2, None), (3, ""), (4, " \n\t\x0b\x0c\r "), (5, "a b c " * 40), (6, "é ü #|$ <x>\né ü #|$ <x>\n \n" + unique(6)),
        (7, "one word \x1cx"), (8, unique(8, 30_000)), (None, unique(9)), (1, unique(1)), (10, "x " * 3), (11, "z" * 100_000),
        (12, "a b c d a b c " + unique(12)), (13, "line\r\nline\r\n" + unique(13)),
    ]
    got = lq.judge(texts(rows, n_words=1, w=2, host=3)).collect()
    found = [(str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]
    assert sorted(found) == sorted((str(doc), *measured(text)) for doc, text in rows)
    assert all(r.kept == (not r.base_failed) for r in got)
    assert lq.judge(texts(rows).limit(0)).collect() == []


def test_boilerplate_counts_different_documents_of_one_host(spark):
    banner = "Accept all Cookies   to go on 0"
    rows = [(k, f"{banner}\n{unique(k)}", "shop") for k in range(20)]
    rows += [(100 + k, f"accept all cookies to go on 0\n{unique(100 + k)}", "other") for k in range(5)]
    rows += [(200 + k, f"{unique('copy')}\nshort line here", "copies") for k in range(40)]
    rows += [(300, "\n".join([banner] * 15), "shop"), (301, "\n".join([banner] * 15), "shop"), (302, f"{banner}\n{unique(302)}", None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in lq.judge(frame).collect()}
    assert all(got[k].n_removed_words == 7 and got[k].kept for k in range(20))
    assert all(got[100 + k].n_removed_words == 0 for k in range(5))  # too few on that host
    assert all(got[200 + k].n_removed_words == 0 and got[200 + k].kept for k in range(40))  # copies are one document
    limits = lq.LineLimits(repeated=1000)
    depleted = {r.doc_id: r for r in lq.judge(frame, limits=limits).collect()}
    assert not depleted[300].base_failed and not depleted[300].kept and depleted[300].n_removed_words == 105
    assert depleted[302].n_removed_words == 0


@pytest.mark.parametrize("query", [op8_line_quality, op10_perspectives])
def test_queries_equal_their_sql(spark, sf_dir, query):
    frame = query(spark, sf_dir)
    columns = sorted(frame.columns)
    cursor = connect(sf_dir).execute(oracle_sql()[query.__name__])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = [tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall()]
    got = [tuple(plain(v) for v in row) for row in frame.select(*columns).collect()]
    assert sorted(got, key=sort_key) == sorted(want, key=sort_key)


def test_no_python_in_the_plan(texts):
    frame = texts([(1, "a")]).selectExpr("doc_id", "text", "source AS host").withColumn("key", lq.F.lit(1).cast("long"))
    for part in (lq.measures(frame), lq.common_lines(lq.document_lines(frame)), lq.removed_words(frame, lq.common_lines(lq.document_lines(frame)))):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_lines_over_the_limits_are_taken_out(spark):
    banner = "Accept all\tCookies   to go on 0"
    body = [f"  {unique(k)} \r\n\n{unique(1000 + k, 5)}\n" for k in range(20)]
    rows = [(k, f"{banner}\r\n{body[k]}{banner.upper()}\n", "shop") for k in range(20)]
    rows += [(100, f"{banner}\n{unique(100)}", "other"), (101, f"{banner}\n{unique(101)}", None), (102, None, "shop"), (103, banner, "shop")]
    frame = spark.createDataFrame([(*row, -1) for row in rows], "doc_id bigint, text string, source string, n_chars bigint")
    common = lq.boilerplate(frame)
    cleaned = lq.without_lines(frame, common)
    assert cleaned.columns == frame.columns
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    got = {r.doc_id: r.text for r in cleaned.collect()}
    assert got == {**dict((k, body[k]) for k in range(20)), 100: rows[20][1], 101: rows[21][1], 102: None, 103: ""}
    lost = {r.doc_id: r.n_removed_words for r in lq.judge(frame, common=common).collect()}
    assert lost == {d: len(WORD.findall(t or "")) - len(WORD.findall(got[d] or "")) for d, t, _ in rows}


def test_the_pipeline_stage_writes_the_text_without_them(spark):
    import corpus_pipeline

    rows = [(k, f"Accept all Cookies\n{unique(k)}", "shop", -1) for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.quality_rules(spark, frame, "").collect()}
    assert got == {k: (unique(k), len(unique(k))) for k in range(20)}


def test_a_line_that_is_the_longest_of_its_documents_is_boilerplate(spark):
    notice = unique("notice", 70)
    rows = [(k, f"{notice}\n{unique(k, 40)}\n{unique(500 + k, 40)}", "shop") for k in range(20)]
    rows += [(100 + k, f"{notice.upper()}\n{unique('copy', 40)} {'' if k % 2 else ' '}", "copies") for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in lq.judge(frame).collect()}
    assert all(got[k].n_removed_words == 70 and got[k].kept for k in range(20))
    assert all(got[100 + k].n_removed_words == 0 for k in range(20))  # copies but for case and blanks are one document


def test_sql_states_the_same_rule_where_a_banner_is_the_longest_line(spark, tmp_path):
    import duckdb

    from spendframe.llm.oracles import oracle_sql
    from spendframe.llm.queries import op8_line_quality

    banner = " ".join(f"notice{i}" for i in range(70))
    own = lambda k: "\n".join(" ".join(f"w{k}x{line}x{i}" for i in range(20)) for line in range(4))
    rows = [(k, f"{banner}\n{own(k)}", "en", "site", 1) for k in range(20)]
    rows += [(100 + k, own(200), "en", "site", 1) for k in range(30)]  # copies count once
    rows += [(200 + k, own(300 + k), "en", "site", 1) for k in range(12)] + [(None, None, None, None, None), (300, banner, "de", None, 2)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = op8_line_quality(spark, str(tmp_path))
    names = sorted(got.columns)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = connection.execute(f"SELECT {', '.join(names)} FROM ({oracle_sql()['op8_line_quality']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*names).collect())
    assert sum(r.n_removed_words == 70 for r in got.collect()) == 20

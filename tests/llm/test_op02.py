"""op2 against a plain Python version, on odd texts and on the given documents."""

import re
import unicodedata
from collections import Counter

from crease.llm import op02_quality as op
from helpers import rows

#: Ends of a sentence with a space after them, and those without.
ENDS, CLOSED = ".!?…:;\"”'’)]»।॥۔؟؛։።፧፨」』）：；", "。．！？｡"


def ends(line):
    return any(c in CLOSED or (c in ENDS and (i + 1 == len(line) or line[i + 1] in " \t\n\x0b\x0c\r")) for i, c in enumerate(line))


def phrase(line):
    """A phrase with neither a letter nor a digit nor an underscore beside it."""
    low = f" {line.lower()} "
    part = lambda c: c == "_" or unicodedata.category(c)[0] in "LN"
    return any(not part(low[m.start() - 1]) and not part(low[m.end()]) for p in op.BOILERPLATE for m in re.finditer(re.escape(p), low))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    lines = (text or "").split("\n")
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    with_word = [l for l in lines if WORD.search(l)]
    kept_lines, lost = [], 0
    for l in lines:
        n = len(WORD.findall(l))
        bad = n > 0 and (not ends(l) or sum(l.count(c) for c in "#*$%&|<>") * 100 > 5 * len(l)
                         or sum(l.count(c) for c in "|»›·•") >= 3 or (n <= 30 and phrase(l)))
        lost += len(l) * bad
        if not bad:
            kept_lines.append(l)
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    kept = not base and lost * 100 <= sum(map(len, lines)) * 30
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(with_word) - len(set(with_word)),
            len(covered), base, kept, lost), "\n".join(kept_lines)


def test_equal_to_brute_force(spark, tmp_path):
    good = " ".join(f"word{i} goes, on." for i in range(60))
    texts = [None, "", " \n\t", "one", "a b a b a b a b", good, good + "\nhome | news | about | more\n\n  ", good + "\n" + good,
             good + "\nAll rights reserved.\nno end here\nyes. no", "é🙂 " * 60 + ".", "x " * 40_000, "\r\n".join([good, "tail", ""]),
             good + "\n" + "\n".join(["my blog in March was long"] * 12 + ["my blog in March was long."] * 12), good + "\nमेरा वाक्य।\n这是一句话。\nلا نهاية",
             good + "\nHier klicken.\nvom hier klickenden.\nLire la suite.", "&%$ " * 100 + ".", "a\x0bb\x0cc\x85d\xa0e.", (good + "\n") * 30]
    data = [(i, t, 1) for i, t in enumerate(texts)] + [(5, good, 1), (None, good, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, _judged int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(op.op2_line_first_cleaning(spark, str(tmp_path)))
    assert sorted(got, key=str) == sorted([(i, *brute(t)[0]) for i, t, _ in data], key=str)
    cleaned = op.clean(df)
    assert cleaned.columns == df.columns
    assert sorted(rows(cleaned), key=str) == sorted([(i, brute(t)[1], x) for i, t, x in data if brute(t)[0][6]], key=str)
    assert op.clean(df.limit(0)).collect() == []


def test_clean_lines_stay(spark):
    lines = ["my blog in March was long.", "We redesign upset plans.", "The fires spread more quickly.", "यह एक साफ वाक्य है।", "یہ ایک جملہ ہے۔", "هل هذا نص؟",
             "Սա նախադասություն է։", "ይህ ዓረፍተ ነገር ነው።", "这是一句话。", "これは文です。続く"]
    bad = ["Read more.", "Please log in, or sign up.", "कोई अंत नहीं", "没有结尾"]
    good = " ".join(f"word{i} goes, on." for i in range(200))
    df = spark.createDataFrame([(1, "\n".join([good, *lines, *bad]))], "doc_id long, text string")
    assert [r.text for r in op.clean(df).collect()] == ["\n".join([good, *lines])]


def test_sql_has_the_same_rules(spark, tmp_path):
    """The registered SQL in DuckDB on lines that tell the rules apart."""
    import duckdb
    good = " ".join(f"word{i} goes, on." for i in range(60))
    lines = ["my blog in March was long.", "यह एक साफ वाक्य है।", "这是一句话。", "Please log in, or sign up.", "no end", "Hier klicken.", "redesign upset.", "leer más!", "x_log in."]
    texts = [good + "\n" + "\n".join(lines[i:] * 12) for i in range(len(lines))] + [None, "", good]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op.op2_line_first_cleaning(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(op.OP2_SQL)
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())


def test_given_documents(spark):
    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    assert sorted(rows(op.op2_line_first_cleaning(spark, path))) == sorted((i, *brute(t)[0]) for i, t in texts.items())

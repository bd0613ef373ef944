import re

from pyspark.sql import functions as F

from kgweave.functions import arrays as A, text as T

NASTY = ["a b", "a　 b", "a\x1cb\x85c", "a\x00b", "x\\ey", "p;q", " lead  trail\t\n", "", " ", "emoji \U0001F600  z", "a\x0bb\x0cc\x08d\x07e"]


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first()[0]


def py_clean(t):
    for ch in "\n\r\t\x0b\x0c\x08\x07":
        t = t.replace(ch, " ")
    return re.sub(r"\s+", " ", t.replace("\\e", " ").replace(";", ",").replace("\x00", "")).strip()


def test_cleaning_matches_python_white_space(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(NASTY)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", T.clean_text("t").alias("c")).collect()}
    assert got == {i: py_clean(t) for i, t in enumerate(NASTY)}
    sq = {r.i: r.c for r in df.select("i", T.squeeze("t").alias("c")).collect()}
    assert sq == {i: re.sub(r"\s+", " ", t).strip() for i, t in enumerate(NASTY)}


def test_graph_path_cleaning_keeps_spaces(spark):
    assert one(spark, " a\n b;c ", T.clean_text_graph) == " a  b,c "


def test_answer_parsing(spark):
    assert one(spark, "x Answer: a Answer: b", T.split_answer) == " b"
    assert one(spark, "the answer:z", T.split_answer) == "z"
    assert one(spark, "x Answer:", T.split_answer) == "none"
    assert one(spark, "The Twenty-One, Été!  Ok", T.normalize_answer) == "the twenty one été ok"
    react = "Thought: hmm\nAction: search for cats\nAnswer: need more\ninformation "
    assert one(spark, react, T.react_thought) == " hmm"
    assert one(spark, react, lambda c: T.react_search_query(T.react_action(c))) == "cats"
    assert one(spark, react, T.react_answer) == "need more\ninformation"
    assert one(spark, " Search for dogs", T.react_search_query) == "Search for dogs"
    assert one(spark, "a</think> b</think> c ", T.strip_think) == "c"


def test_listing_and_paths(spark):
    assert one(spark, "a\n\n b\n", T.count_listed) == 2
    assert one(spark, "All recognized", T.count_listed) == 0
    assert one(spark, "1. ['x', 'y y']\nnothing\n['z']", T.bracket_items) == ["x", "y y", "z"]
    got = one(spark, "/people/person/born./loc/place/name", T.relation_path)
    assert [(r.relation, r.concepts) for r in got] == [("born", ["people", "person"]), ("name", ["loc", "place"])]
    assert one(spark, "Answer: 1, 9, 0, 3", lambda c: T.wrong_segment_ids(c, F.lit(5))) == [1, 3]
    assert one(spark, "ALL_CORRECT", lambda c: T.wrong_segment_ids(c, F.lit(5))) == []
    assert one(spark, "I checked 2 facts and 3 sources.", lambda c: T.wrong_segment_ids(c, F.lit(5))) == []
    assert one(spark, "Answer: 1\nAnswer: 2", lambda c: T.wrong_segment_ids(c, F.lit(5))) == [1, 2]


def test_ratings_and_filters(spark):
    assert one(spark, " 4 ", T.rating) == 4 and one(spark, "four", T.rating) is None
    assert one(spark, "5, x, 3, 2", lambda c: T.rating_list(c, 2)) == [5, 3]
    assert one(spark, "(B) or (C)", lambda c: T.regex_pick(c, r"\(([A-D])\)", 1, -1)) == "C"
    assert one(spark, "none", lambda c: T.regex_pick(c, r"\(([A-D])\)", 1)) == "[invalid]"
    assert one(spark, "answer: (A)", lambda c: T.first_char_choice(c, r":\s*\(?[A-D]\)?")) == "("
    assert one(spark, "do n't ( a ) , b", T.detokenize) == "don't (a), b"
    assert one(spark, "org/model:x", T.safe_name) == "org__model__x"


def test_ngrams_and_offsets(spark):
    text = "  a bb ccc  d e "
    grams = one(spark, text, lambda c: A.word_ngrams_with_offsets(c, 3))
    words = [(m.group(), m.start(), m.end() - 1) for m in re.finditer(r"\S+", text)]
    want = [(" ".join(w[0] for w in words[i:i + 3]), words[i][1], words[i + 2][2]) for i in range(len(words) - 2)]
    assert [(g.ngram, g.start, g.end) for g in grams] == want
    assert one(spark, "a b", lambda c: A.word_ngrams(c, 3)) == []


def py_windows(tok, prefix, max_len, ctx):
    out, pred = [], max_len - ctx + 1
    if not tok:
        return out
    done = min(max_len, len(tok))
    out.append(([prefix] + tok[:done - 1], tok[:done]))
    while done < len(tok):
        n = min(len(tok) - done, pred)
        end = done + n
        padded = [prefix] + tok
        out.append((padded[end - max_len:end], tok[end - n:end]))
        done = end
    return out


def test_rolling_windows(spark):
    for n, m, c in [(0, 4, 1), (3, 4, 1), (10, 10, 1), (33, 10, 5), (30, 10, 10), (11, 4, 2)]:
        tok = list(range(n))
        got = one(spark, tok, lambda x, m=m, c=c: A.rolling_windows(x, F.lit(-100).cast("bigint"), m, c), "array<bigint>")
        assert [(w.context, w.predicted) for w in got] == py_windows(tok, -100, m, c)
        assert [t for w in got for t in w.predicted] == tok
    assert one(spark, [1, 2, 3, 4, 5], lambda x: A.disjoint_window(x, F.slice(x, 4, 2)), "array<bigint>") == [1, 2, 3, 4]


def test_vectors_and_metrics(spark):
    s = one(spark, [1.0, 1.0, 2.0], A.softmax, "array<double>")
    assert abs(sum(s) - 1) < 1e-12 and abs(s[2] / s[0] - 2.718281828459045) < 1e-9
    assert one(spark, [1.0, 3.0, 3.0], A.argmax, "array<double>") == 1
    assert one(spark, [0.0, 0.0], A.l2_normalize, "array<float>") == [0.0, 0.0]
    assert one(spark, [3.0, 4.0], lambda c: A.cosine(c, F.array(F.lit(0.0), F.lit(0.0))), "array<double>") is None
    assert one(spark, "a b b", lambda c: A.token_f1(T.tokens(c), T.tokens(F.lit("b b c")))) == 2 * (2 / 3) * (2 / 3) / (4 / 3)
    assert one(spark, "", lambda c: A.token_f1(T.tokens(c), T.tokens(c))) == 0.0


def test_phrase_drops_stop_words_and_keeps_order(spark):
    assert one(spark, "The  Bank, of the (New) Bank!", lambda c: T.phrase(c, ("the", "of"))) == "bank new bank"

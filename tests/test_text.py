import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import chunking as C
from brindle.functions import text as X
from brindle.functions.similarity import ratcliff

quick = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first().x


def many(spark, column, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", column.alias("x")).collect()
    return [r.x for r in sorted(rows)]


def test_normalize(spark):
    cases = {"好好。。。！！": "好好。!", "a\r\n\n\n\nb": "a\n\nb", "10K and 1.5m": "10,000 and 1,500,000", "NT$5, NTD  7": "NTD 5, NTD 7", "０１　x": "01 x",
        "0.1234567k": "123.457", "1.5k!!": "1,500!"}
    for given_, want in cases.items():
        assert one(spark, X.normalize("text"), given_) == want, given_


def test_nfkc(spark):
    texts = ["ﬁ", "①", None, "é", "Ａ"]
    assert many(spark, X.nfkc("text"), texts) == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def test_reflow(spark):
    text = "# Head\nline one\nline two\n\n- item\n```\ncode  x\n  y\n```\nlast"
    assert one(spark, X.reflow("text"), text) == "# Head\n\nline one line two\n\n- item\n\n```\n\ncode  x\n\n  y\n\n```\n\nlast"


def test_html(spark):
    page = "<html><nav>menu</nav><script>x<y</script><p>One <b>bold</b></p><p> </p><p>Two</p></html>"
    assert one(spark, X.strip_html("text"), page) == "One bold Two"
    assert one(spark, X.paragraphs("text"), page) == ["One bold", "Two"]
    assert one(spark, X.html_blocks("text"), "<p>a &amp; b</p><aside>no</aside><p>c</p>") == "a & b\n\nc"
    assert many(spark, X.drop_noise("text"), ["廣告", "看廣告吧", "TOC", "x"]) == [None, "看吧", None, "x"]


def test_sanitize(spark):
    cases = {None: "", "a\x00b\nc": "abc", "<script>x</script>": "x", "a & b < c": "a &amp; b &lt; c", "\"q\" 'r'": "&quot;q&quot; &#x27;r&#x27;",
        "<" + "a" * 101 + ">": "&lt;" + "a" * 101 + "&gt;"}
    assert many(spark, X.sanitize("text"), list(cases)) == list(cases.values())
    assert one(spark, X.sanitize("text", 3), "abcdef") == "abc"


def test_redact(spark):
    def run(text, **k):
        return one(spark, X.redact("text", **k), text)

    r = run("mail a.b@x.com or 0912-345-678, +886 2 1234 5678, sk-" + "a" * 20)
    assert r.text == "mail [REDACTED_EMAIL] or [REDACTED_PHONE], [REDACTED_PHONE], [REDACTED_APIKEY]" and r.stats == {"email": 1, "phone": 2, "apikey": 1}
    assert run("a+b@x.com").text == "a+[REDACTED_EMAIL]" and run("on 2025-10-01").text == "on [REDACTED_PHONE]"
    assert run("x@y.com", mode="off").text == "x@y.com" and run("x@y.com", mode="off").stats == {}
    assert run(None).text == "" and run("none").stats == {"email": 0, "phone": 0}
    assert run("x@y.com", kinds=()).text == "x@y.com" and run("abc", max_length=2).truncated


def test_bulletize_and_focus(spark):
    assert many(spark, X.bulletize("text"), ["a；b；c；d", "one. two. ", "single", " x, y ", ""]) == [["a", "b", "c"], ["one", "two"], ["single"], ["x", "y"], [""]]
    assert one(spark, X.numbered(X.bulletize("text")), "a。b") == "1) a\n2) b"
    assert one(spark, X.focus("text"), " " + "字" * 30 + "。") == "字" * 20


def test_snippet(spark):
    assert one(spark, X.snippet("text", F.lit("KEY"), 6), "abcdefkeyhij") == "defkey"
    assert one(spark, X.snippet("text", F.lit("none"), 4), "abcdef") == "abcd"


def test_json(spark):
    got = many(spark, X.extract_json("text"), ['{"a": 1}', 'so: {"b": 2} end', "none", "{broken"])
    assert got == ['{"a": 1}', '{"b": 2}', '{"raw_output":"none"}', '{"raw_output":"{broken"}']
    assert one(spark, X.strip_fences("text"), '```json\n{"a":1}\n```') == '{"a":1}'


def test_render(spark):
    df = spark.createDataFrame([("Hi {{ name }}, {{gone}}{{cost}}",)], "t string")
    assert df.select(X.render("t", {"name": F.lit("A$1\\"), "cost": F.lit("$5")}).alias("x")).first().x == "Hi A$1\\, $5"
    assert one(spark, X.single_braces("text"), "{{ x }} {{y}}") == "{x} {y}"
    parts = one(spark, X.chatml_parts(X.chatml("text", F.lit(" yes "))), "ok?")
    assert (parts.question, parts.answer) == ("ok?", "yes")


def test_small_rules(spark):
    assert many(spark, X.judged("text"), ["ok.", " OK", "Hallu", ""]) == ["OK", "OK", "Hallucination", "Hallucination"]
    assert one(spark, X.answer_issues("text"), "see /etc/x, http then {") == ["server_path", "no_valid_url", "open_json"]
    assert many(spark, X.tokens_by_words("text"), ["two words", "中文 x"]) == [2, 3]
    assert many(spark, X.tokens_by_length("text"), ["", "12345678"]) == [1, 2]
    assert one(spark, X.model_name(F.lit(""), F.col("text"), "d"), "m1 or m2") == "m1"
    assert one(spark, X.model_name(F.lit("fake"), F.col("text"), "d"), "m1") == "d"
    df = spark.createDataFrame([("abcd", "bcde"), (None, "x")], "a string, b string")
    assert [r.x for r in df.select(ratcliff("a", "b").alias("x")).collect()] == [0.75, None]


def test_fixed_and_sliding(spark):
    assert one(spark, C.fixed("text", 4, 1), "abcdefg") == ["abcd", "defg", "g"]
    assert one(spark, C.sliding("text", 4, 1), "abcdefg") == ["abcd", "defg"]
    assert many(spark, C.sliding("text", 4, 1), ["", "abc"]) == [[], ["abc"]]
    assert one(spark, C.sliding("text", 0, 1), "abc") == ["abc"] and one(spark, C.sliding("text", 4, 9), "abcdefg") == ["abcd", "defg"]


@quick
@given(st.lists(st.text(alphabet="ab 。\n", max_size=60), min_size=1, max_size=20))
def test_sliding_covers(spark, texts):
    for text, chunks in zip(texts, many(spark, C.sliding("text", 7, 2), texts)):
        joined = "".join(c if i == 0 else c[2:] for i, c in enumerate(chunks))
        assert joined == text and all(len(c) <= 7 for c in chunks)


@quick
@given(st.lists(st.text(alphabet="ab 。？", max_size=80), min_size=1, max_size=20))
def test_packed_sentences_fold(spark, texts):
    def fold(text, most, overlap):
        done, held = [], ""
        for s in [x.strip() for x in re.split(r"(?<=[。！？?])\s*", text) if x.strip()]:
            if len(held) + len(s) + bool(held) <= most:
                held = f"{held} {s}".strip()
            elif held:
                done.append(held)
                held = f"{held[-overlap:]} {s}".strip()
            else:
                done.append(s[:most])
                held = s[most - overlap :]
        return done + [held] if held else done

    for text, chunks in zip(texts, many(spark, C.packed_sentences("text", 12, 4), texts)):
        assert chunks == fold(text, 12, 4)


def test_other_chunks(spark):
    assert one(spark, C.packed_lines("text", 8), "abc\ndef\nghijklmnop\nq") == ["abc\ndef", "ghijklmnop", "q"]
    assert one(spark, C.paragraphs_capped("text", 3), " abcd \n\nx") == ["abc", "d", "x"] and one(spark, C.paragraphs_capped("text"), " ") == ["(空文件)"]
    assert one(spark, C.by_topic("text"), "報銷要發票。請假一天。遲到三次！出差。") == ["報銷要發票。", "請假一天。遲到三次。", "出差。"]
    assert one(spark, C.by_rules("text"), "序\n第一章 甲\n內文\n1. 乙\n 丙 ") == ["序", "第一章 甲 內文", "1. 乙 丙"]
    assert one(spark, C.token_windows("text", 3, 1), "a b c d e") == ["a b c", "c d e"] and one(spark, C.token_windows("text", 3, 1), " a ") == ["a"]
    assert one(spark, C.kept_sentences("text"), "一。 二？三") == ["一。", "二？", "三"]


def test_white_space_is_found_alike_by_trimming_and_by_patterns(spark):
    """The ends are looked at alone; what goes is what the pattern of white space takes away, each character of it, in any run."""
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    texts = [f"{w}a{w}{w}b {w}{v}" for w in spaces for v in ("", "\n", "\x85", "!")] + ["", " ", "​ a", "﻿", "a~ !", "".join(spaces), None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", X.strip("text").alias("s"), X.norm_ws("text").alias("n"), F.regexp_replace("text", f"^{X.WS}+|{X.WS}+$", "").alias("want")).collect():
        assert r.s == r.want == (r.text if r.text is None else r.text.strip()), repr(r.text)
        assert r.n == (r.text if r.text is None else " ".join(r.text.split())), repr(r.text)
    # the trimming has no pattern that is tried at every character of a text
    plan = df.select(X.strip("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan


def test_documents_sentences_meet_the_items_before_they_are_shuffled(spark, data):
    """contamination_overlap: only sentences that an item has are made distinct."""
    from brindle.plans.text_queries import contamination

    plan = contamination(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 2

"""Line parsing: the strict rules, the cheapest edits, and defined results for odd input."""

import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from latentspark.operators import parse

COLUMNS = (parse.Column("id"), parse.Column("a", "number", 1, 7), parse.Column("g", "word", codes=frozenset({"female", "f"})), parse.Column("note"))
FEED = parse.Feed(",", COLUMNS)
P = parse.splitter(",")


def reason(line):
    return parse.judge(line, FEED, P)[0]


@pytest.mark.parametrize(
    "line, expected",
    [
        ("1,3,F,ok", None),
        ('1,3,"female","a ""b"", c\nd"\r', None),
        ("1,NA,,x", None),
        ("1,-99, f ,x", None),
        ('1,3,f,"open', "quoting"),
        ('1,3,f,a"b', "quoting"),
        ('1,3,"f"x,a', "quoting"),
        (' "1",3,f,a', "quoting"),
        ("", "columns"),
        (None, "columns"),
        ("1,3,f", "columns"),
        ("1,3,f,x,y", "columns"),
        ("1,8,f,x", "invalid"),
        ("1,3.0,f,x", "invalid"),
        ("1,３,f,x", "invalid"),
        ("1,3,x,x", "invalid"),
        ("1,3,f,x\r\r", None),
    ],
)
def test_reasons(line, expected):
    assert reason(line) == expected


def test_edits_name_the_repair():
    assert parse.cheapest_edits('1,3,f,a"b', ",", 4) == (0, 1, 0, 0)
    assert parse.cheapest_edits('1,3,f,"ab', ",", 4)[:2] in ((1, 0), (0, 1))
    assert parse.cheapest_edits("1,3", ",", 4) == (0, 0, 2, 0)
    assert parse.cheapest_edits("1,3,f,x,y,z", ",", 4) == (0, 0, 0, 2)
    assert parse.cheapest_edits('a,"",a,""', ",", 3) == (0, 0, 0, 1)
    assert reason('"1","3","f","x",y,"z"') == "columns"


def strict(line):
    """The quoting rules by a plain automaton."""
    state = "start"
    for ch in line:
        if state == "start":
            state = "quoted" if ch == '"' else "start" if ch == "," else "plain"
        elif state == "plain":
            if ch == '"':
                return False
            state = "start" if ch == "," else "plain"
        elif state == "quoted":
            state = "closed" if ch == '"' else "quoted"
        else:
            if ch not in '",':
                return False
            state = "quoted" if ch == '"' else "start"
    return state != "quoted"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='a",\n', max_size=14))
def test_quoting_agrees_with_an_automaton_and_with_the_edits(line):
    fields = parse.zero_cost_fields(line, ",", P)
    assert (fields is not None) == strict(line)
    edits = parse.cheapest_edits(line, ",", 3)
    if fields is None:
        assert edits[0] + edits[1] > 0
    else:
        assert edits[:2] == (0, 0) and (sum(edits) == 0) == (len(fields) == 3)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet='ab",\n x', max_size=6), min_size=1, max_size=5))
def test_round_trip_of_written_lines(fields):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(fields)
    assert parse.zero_cost_fields(out.getvalue(), ",", P) == fields


def test_very_long_line_is_decided_in_time():
    assert reason("1,3,f," + "x" * 2_000_000) is None
    assert reason("1,3,f," + '"' + "y" * 1_000_000) == "quoting"
    assert reason("," * 3_000) == "columns"


def test_lines_of_all_kinds(spark):
    rows = [(1, "s", "f1", 1, "id,a,g,note"), (2, "s", "f1", 2, "1,3,f,x"), (3, "s", "f1", 3, None), (4, None, "f1", 4, "x"), (2, "s", "f1", 2, "1,3,f,x")]
    df = spark.createDataFrame(rows, "line_id long, feed string, file_name string, line_no int, line string").selectExpr("*", "'z' AS reason")
    got = sorted((r.line_id, r.reason or "", len(r.fields or [])) for r in parse.parse_lines(df, {"s": FEED}).collect())
    assert got == [(2, "", 4), (2, "", 4), (3, "columns", 0), (4, "invalid", 0)]
    assert parse.parse_lines(df.limit(0), {"s": FEED}).count() == 0


def test_both_ways_of_judging_agree(spark):
    import random

    rnd = random.Random(3)
    pieces = ['"', '""', ",", ",", ",", "1", "10", "-3", " 4 ", " 5", "NA", "-99", "f", "FEMALE", "x", "\n", "\t", "\r", "007", "+1", "1.0", "9" * 20, "'", "\\", "٠"]
    lines = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    lines += [",".join(rnd.choice(["1", "3", " 2", "11", '"4"', "NA", "f", '"M"', 'a ""', '"a ""b"""', "", '"x,y"']) for _ in range(4)) + rnd.choice(["", "\r"]) for _ in range(3000)]
    lines += ["1,3,f," + "x" * 3000, '1,3,f,"' + '""' * 5000 + '"', '1,77,f,"' + '""' * 5000 + '"']
    df = spark.createDataFrame([(i, "s", 2, t) for i, t in enumerate(lines)], "line_id long, feed string, line_no int, line string")
    got = {r.line_id: (r.reason, r.detail, r.fields) for r in parse.parse_lines(df, {"s": FEED, "other": parse.Feed(";", ())}).collect()}
    for i, t in enumerate(lines):
        want = parse.judge(t, FEED, P)
        assert got[i] == want, (t, got[i], want)
    assert sum(v[0] is None for v in got.values()) > 300


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='a",\n', max_size=14), max_size=12), st.integers(1, 5))
def test_edits_of_many_lines_equal_those_of_each(lines, fields):
    assert parse.cheapest_edits_of(lines, ",", fields) == [parse.cheapest_edits(x, ",", fields) for x in lines]

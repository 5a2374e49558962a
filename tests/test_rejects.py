import csv
import io

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from slicelake.operators import rejects

H = "@NS1:1:FC:1:1101:5:6"


def reasons(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "raw_id int, raw_line string")
    return {r["raw_id"]: r["reason"] for r in rejects.classify(df).collect()}


def split_strictly(line):
    """Brute force: fields by the format's grammar, None where it can't be split."""
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i, out = i + 1, []
            while True:
                if i >= n:
                    return None
                if line[i] == '"':
                    if i + 1 < n and line[i + 1] == '"':
                        out.append('"')
                        i += 2
                        continue
                    i += 1
                    break
                out.append(line[i])
                i += 1
            fields.append("".join(out))
        else:
            j = i
            while j < n and line[j] not in ',"':
                j += 1
            fields.append(line[i:j])
            i = j
        if i == n:
            return fields
        if line[i] != ",":
            return None
        i += 1


def test_each_reason(spark):
    ok = f"1,{H},ACGT,+,IIII"
    lines = [
        ok, ok + "\r", f'"1","{H}","ACGT","+","IIII"', f'1,"{H} ""kept""",ACGT,+,IIII', f'1,{H},AC,+,"I,"',
        f'1,"{H},ACGT,+,IIII', f'1,{H}"x",ACGT,+,IIII', None, "", "\r", f"1,{H},ACGT,+", ok + ",x", f"0,{H},ACGT,+,IIII", f"-1,{H},ACGT,+,IIII",
        f"1,{H[1:]},ACGT,+,IIII", "1,@a:b:c:L1:2:3:4,ACGT,+,IIII", "1,@a:b:1:2:3:4,ACGT,+,IIII", f"1,{H},ACXT,+,IIII", f"1,{H},,+,", f"1,{H},ACGT,++,IIII", f"1,{H},ACGT,+,III", f"1,{H},ACGT,+,II I", f"007,{H},N,+,!",
        f"99999999999999999999999,{H},A,+,I", f"1,{H}\n,A,+,I",
    ]
    want = [None, None, None, None, None, "quoting", "quoting", "column_count", "column_count", "column_count", "column_count", "column_count", "record_no", "record_no", "header_line", "header_line", "header_line", "seq_line", "seq_line", "plus_line", "qual_line", "qual_line", None, None, "header_line"]
    got = reasons(spark, lines)
    assert [got[i] for i in range(len(lines))] == want


def test_very_long_and_clashing(spark):
    long_ok = f"1,{H},{'A' * 300000},+,{'I' * 300000}"
    quotes = "1," + '"' + '""' * 200000 + '"' + ",A,+,I"
    df = spark.createDataFrame([(1, long_ok, "x"), (2, quotes, "y"), (1, long_ok, "x")], "raw_id int, raw_line string, seq_line string")
    got = sorted((r["raw_id"], r["reason"]) for r in rejects.classify(df).select("raw_id", "reason").collect())
    assert got == [(1, None), (1, None), (2, "header_line")]
    assert rejects.valid_records(df).count() == 2
    assert rejects.classify(df.limit(0)).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='a,"\n \r', max_size=12), min_size=20, max_size=60))
def test_splitting_matches_grammar(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "raw_id int, raw_line string")
    got = {r["raw_id"]: (r["quoting_fails"], r["fields"]) for r in rejects.read_permissive(df).collect()}
    for i, line in enumerate(lines):
        body = line.removesuffix("\r")
        want = split_strictly(body)
        if body == "":
            assert got[i] == (False, None)
        elif want is None:
            assert got[i][0], line
        else:
            assert got[i] == (False, want), line


def test_round_trip_through_csv_writer(spark):
    rows = [[str(i), f"{H} x,y \"{i}\"", "ACGT", "+", 'I,"I'] for i in range(1, 30)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    df = spark.createDataFrame(list(enumerate(out.getvalue().split("\n")[:-1])), "raw_id int, raw_line string")
    got = {r["raw_id"]: [str(r["record_no"]), r["header_line"], r["seq_line"], r["plus_line"], r["qual_line"]] for r in rejects.valid_records(df).collect()}
    assert got == dict(enumerate(rows))


def test_numbers_of_any_length_are_kept(spark):
    numbers = ["7", "007", "9" * 20, "9" * 38, "00" + "1" * 45, '"42"', "1e5", "1.5", "+3", " 4", "0"]
    df = spark.createDataFrame([(i, f"{n},{H},A,+,I") for i, n in enumerate(numbers)], "raw_id int, raw_line string")
    got = {r["raw_id"]: (r["reason"], int(r["record_no"]) if r["record_no"] is not None else None, r["record_no_long"]) for r in rejects.classify(df).collect()}
    assert [got[i] for i in range(6)] == [(None, 7, None), (None, 7, None), (None, int("9" * 20), None), (None, int("9" * 38), None), (None, None, "1" * 45), (None, 42, None)]
    assert [got[i][0] for i in range(6, 11)] == ["record_no"] * 5


def test_very_many_fields(spark):
    lines = ["," * 100_000, f"1,{H},ACGT,+,IIII" + ",x" * 30_000, f"1,{H},ACGT,+,IIII", "," * 10, '"' + "," * 100_000]
    assert reasons(spark, lines) == {0: "column_count", 1: "column_count", 2: None, 3: "column_count", 4: "quoting"}

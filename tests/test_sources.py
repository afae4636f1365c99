import pytest

from tablegauge import operators as ops
from tablegauge import sources
from tablegauge.errors import EmptyTableError, LoadError


@pytest.fixture
def write(tmp_path):
    def made(name: str, content) -> str:
        path = tmp_path / name
        path.write_bytes(content.encode() if isinstance(content, str) else content)
        return str(path)

    return made


def test_read(spark, write):
    df = sources.read_csv(spark, write("tides.csv", "port,height\n7,-3\n2,11\n9,0\n"))
    assert df.dtypes == [("port", "bigint"), ("height", "bigint")] and sorted(df.collect()) == [(2, 11), (7, -3), (9, 0)]


def test_errors(spark, write):
    mixed = [write("spring.csv", "tide;moon\n4;1\n"), write("neap.csv", "tide;wind\n2;8\n")]
    with pytest.raises(LoadError, match="different headers"):
        sources.read_csv(spark, mixed, sep=";")
    for nothing in ("tide,moon\n", ""):
        with pytest.raises(EmptyTableError, match="File is empty"):
            sources.read_csv(spark, write("nothing.csv", nothing))
    with pytest.raises(LoadError, match="File not found"):
        sources.read_csv(spark, write("there.csv", "tide\n1\n").replace("there", "elsewhere"))


def test_encodings(spark, write):
    marked = sources.read_csv(spark, write("marked.csv", "\ufeffhavn,dybde\nRibe,4\n"))
    assert marked.columns == ["havn", "dybde"] and marked.collect() == [("Ribe", 4)]
    both = [write("u.csv", "fjord\nLimfjorden på dansk\n"), write("l.csv", "fjord\nÅrøsund ¾\n".encode("latin-1"))]
    assert sorted(r[0] for r in sources.read_csv(spark, both).collect()) == ["Limfjorden på dansk", "Årøsund ¾"]
    names = sources.read_csv(spark, write("names.csv", "dybde,ø\n3,Læsø\n".encode("latin-1")))
    assert names.columns == ["dybde", "ø"] and names.collect() == [(3, "Læsø")]
    assert sorted(r["valid_utf8"] for r in sources.encoding_check(spark, both).collect()) == [False, True]


def test_headers(spark, write):
    assert sources.read_csv(spark, write("h.csv", "a,a,,b.c\n1,2,3,4\n")).columns == ["a", "a.1", "Unnamed: 2", "b.c"]


def test_types_and_missing_tokens(spark, write):
    text = 'i,d,b,t,n,u,z,q,o\n1,1.5,true,x,NA,9223372036854775808,0012,"a,""b",1\n2,1e3,FALSE,,,1,1e3,l,NULL\n'
    df = sources.read_csv(spark, write("t.csv", text))
    assert dict(df.dtypes) == {
        "i": "bigint", "d": "double", "b": "boolean", "t": "string", "n": "double", "u": "decimal(20,0)",
        "z": "double", "q": "string", "o": "bigint",
    }
    first, second = sorted(df.collect())
    assert first["q"] == 'a,"b' and first["z"] == 12.0 and second["t"] is None and second["o"] is None
    # A suffix of a number or a short word is no number and no truth value.
    words = sources.read_csv(spark, write("w.csv", "a,b\n1d,yes\n2f,no\n"))
    assert dict(words.dtypes) == {"a": "string", "b": "string"}


def test_ragged_rows(spark, write):
    short = sources.read_csv(spark, write("s.csv", "a,b,c\n1,2\n3,4,5\n\n   \n"))
    assert sorted(short.collect(), key=str) == [(1, 2, None), (3, 4, 5)]
    path = write("l.csv", "a,b,c\n1,2,3,4\n3,4,5\n")
    with pytest.raises(Exception, match="more cells than the header"):
        sources.read_csv(spark, path).collect()
    assert sources.read_csv(spark, path, on_bad_rows="drop").collect() == [(3, 4, 5)]
    assert sources.bad_rows(spark, path).collect()[0]["cells"] == ["1", "2", "3", "4"]


def test_delimiter_and_narrow_types(spark, write):
    assert sources.read_csv(spark, write("semi.csv", "a;b\n1;2\n"), sep="auto").collect() == [(1, 2)]
    assert sources.read_csv(spark, write("n.csv", "a,b\n1,200\n3,70000\n"), narrow=True).dtypes == [
        ("a", "tinyint"), ("b", "int"),
    ]


def test_quoted_line_breaks(spark, write):
    path = write("q.csv", 'a,b\n1,"x\ny"\n2,z\n')
    for multi_line in (True, None):
        assert sorted(sources.read_csv(spark, path, multi_line=multi_line).collect()) == [(1, "x\ny"), (2, "z")]
    both = [path, write("plain.csv", "a,b\n3,w\n")]
    assert sorted(sources.read_csv(spark, both).collect()) == [(1, "x\ny"), (2, "z"), (3, "w")]


def test_all_cells_of_overlong_rows(spark, write):
    path = write("long.csv", 'k,m\n1,2\n3,4,,x\n5,6,7,"8 ""b"", c",9\n"10,1",11,\n12\n')
    with pytest.raises(Exception, match="more cells than the header"):
        sources.read_csv(spark, path).collect()
    kept = sources.read_csv(spark, path, on_bad_rows="drop").collect()
    assert sorted(kept, key=str) == [("1", 2), ("10,1", 11), ("12", None)]
    cells = sorted(r["cells"] for r in sources.bad_rows(spark, path).collect())
    assert cells == [["3", "4", "", "x"], ["5", "6", "7", '8 "b", c', "9"]]
    piped = write("piped.csv", "k|m\n1|2|3|4\n")
    assert [r["cells"] for r in sources.bad_rows(spark, piped, sep="|").collect()] == [["1", "2", "3", "4"]]


def test_rows_of_blank_cells_are_rows(spark, write):
    found = sources.read_csv(spark, write("blank.csv", "k,m,n\n  ,,\n   \nu,v,w\n")).collect()
    assert sorted(map(tuple, found), key=str) == [("  ", None, None), ("u", "v", "w")]


def test_names_of_files(spark, tmp_path):
    for name in ("my data.csv", "50%+ü#1.csv"):
        path = tmp_path / "a folder" / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("k,m\n1,2\n")
        df = sources.read_csv(spark, str(path), file_column="from")
        assert [(r["from"].rsplit("/", 1)[1], r["k"]) for r in df.collect()] == [(name, 1)]
        assert sources.quick_scan(spark, str(path)).collect()[0]["rows"] == 1


def test_quick_scan(spark, write):
    paths = [
        write("c.csv", "a,b,c\n1,2,3\n4,5,6\n\n"), write("s.csv", "a;b;c\n1;2;3\n"), write("e.csv", ""),
        write("one.csv", "alone\n1\n \n"), write("tie.csv", "a,b;c\n1\n"),
    ]
    rows = {r["file"].rsplit("/", 1)[1]: r for r in sources.quick_scan(spark, paths).collect()}
    assert (rows["c.csv"]["rows"], rows["c.csv"]["columns"], rows["c.csv"]["delimiter"]) == (2, 3, ",")
    assert (rows["s.csv"]["rows"], rows["s.csv"]["delimiter"]) == (1, ";")
    assert (rows["e.csv"]["rows"], rows["e.csv"]["columns"]) == (0, 0)
    assert (rows["one.csv"]["rows"], rows["one.csv"]["columns"]) == (1, 1)
    assert rows["tie.csv"]["delimiter"] == "," and rows["c.csv"]["file_size_kb"] == 19 / 1024
    with pytest.raises(LoadError):
        sources.quick_scan(spark, "/does/not/exist.csv")


def test_profile_files(spark, write):
    paths = [write("one.csv", "a,b\n1,2\n3,4\n"), write("two.csv", "a,b\n1,\n3,4\n")]
    rows = sources.profile_files(spark, paths, ops.missing_percentage).collect()
    found = {(r["file"].rsplit("/", 1)[1], r["column"]): r["percentage"] for r in rows}
    assert found == {("one.csv", "a"): 0.0, ("one.csv", "b"): 0.0, ("two.csv", "a"): 0.0, ("two.csv", "b"): 50.0}


def test_generated_table_does_not_depend_on_partitions(spark):
    one = sources.generate_messy(spark.range(0, 3000, 1, 1))
    many = sources.generate_messy(spark.range(0, 3000, 1, 9))
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()
    assert ops.duplicate_rows(one).collect()[0][0] > 0
    missing = {r["column"]: r["percentage"] for r in ops.missing_percentage(one).collect()}
    assert 2 < missing["income"] < 6


def test_quotes_that_are_never_closed(spark, write):
    for text in ('k,m\n1,"x\n2,y\n3,z\n', 'k,m\n"a\nb",1\n2,"c', 'k,m\n1,"say ""hi""\n', '"k,m\n1,2\n'):
        path = write("open.csv", text)
        assert [r["unclosed"] for r in sources.unclosed_quotes(spark, path).collect()] == [True]
        with pytest.raises(LoadError, match="never closed"):
            sources.read_csv(spark, path)
    # Quotes within a cell are letters; some of these lines have an odd number of them.
    path = write("inch.csv", 'k,m\n5" pipe,1\n6" pipe,"2"\n"7"" pipe",3\n"a\n5"" b,",4\n')
    assert [r["unclosed"] for r in sources.unclosed_quotes(spark, path).collect()] == [False]
    assert sorted(sources.read_csv(spark, path).collect()) == [('5" pipe', 1), ('6" pipe', 2), ('7" pipe', 3), ('a\n5" b,', 4)]
    plain = write("plain_inch.csv", 'k,m\n5" pipe,1\n6" ""pipe,"2"\n')
    assert not sources.csv_files._checked(spark, plain, ",").first()["open"]


def test_line_breaks_in_the_header(spark, write):
    path = write("head.csv", '"first\nname",m,m\n"a\nb",2,3\nc,4,5\n')
    df = sources.read_csv(spark, path)
    assert df.columns == ["first\nname", "m", "m.1"]
    assert sorted(df.collect()) == [("a\nb", 2, 3), ("c", 4, 5)]


def test_files_of_different_headers_and_types(spark, write):
    """One job over all files gives what each file gives alone."""
    paths = [
        write("p1.csv", "k,m\n1,2\n3,4\n"), write("p2.csv", "k,m\n1,x\n,y\n"), write("p3.csv", "u;k\n"),
        write("p4.csv", "z\n0.5\n0.7\nN/A\n"), write("p5.csv", "k,m\nNA,\n,7\n"), write("p6.csv", 'k,m\n"a\nb",2\n'),
    ]
    for operator in (ops.column_types, ops.missing_percentage, ops.distribution_shape):
        found = {(r["file"].rsplit("/", 1)[1], *tuple(r)[1:]) for r in sources.profile_files(spark, paths, operator).collect()}
        alone = {
            (path.rsplit("/", 1)[1], *tuple(r))
            for path in paths if "p3" not in path for r in operator(sources.read_csv(spark, path)).collect()
        }
        assert found == alone
    with pytest.raises(LoadError, match="different headers"):
        sources.profile_files(spark, paths, ops.shape, per="'all'")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_not_sorted(spark, write):
    """Lines are combined by hash; texts and places kept alone would be sorted by file first."""
    path = write("breaks.csv", 'k,m\n1,"x\ny"\n2,z\n')
    for found in (sources.encoding_check(spark, path), sources.quick_scan(spark, path)):
        assert "SortAggregate" not in _plan(found)
    unclosed = _plan(sources.unclosed_quotes(spark, path))
    # Lines meet a row per file without an exchange, and are combined per block by hash.
    assert "SortMergeJoin" not in unclosed and " HashAggregate(keys=[path" in unclosed.replace("- ", "  ")


def test_quotes_over_many_lines(spark, write):
    """Lines without quotes keep the state before them; those that swap count behind the last deciding one only."""
    texts = {
        "closed": ('k,m\n1,"a\n\nb\n5,"x\nc\nd"\n', False),  # a line that swaps, then a deciding one
        "swapped": ('k,m\n1,"a\nb\n5,"x\n', False),
        "opened": ('k,m\n1,2\n3,"a\n\nb\n', True),
    }
    for name, (text, unclosed) in texts.items():
        found = sources.unclosed_quotes(spark, write(f"{name}.csv", text)).collect()
        assert [r["unclosed"] for r in found] == [unclosed], name


def test_types_of_odd_cells(spark, write):
    """Each cell is looked at once for all types, also where several fit, or none."""
    cells = {
        "bigint": ["9223372036854775807", "-1", " 4 "], "decimal(20,0)": ["18446744073709551615", "0"],
        "double": ["-18446744073709551615", "1", "-inf", "Infinity", "+INF", ".5", "1e3"], "boolean": ["True", "false"],
        "string": ["1995-03-01", "1"],
    }
    for data_type, column in cells.items():
        texts = spark.createDataFrame([(c,) for c in [*column, None]], "k string")
        plan = sources.csv_files.infer_types(texts)
        assert plan.dtypes == [("k", data_type)], data_type
    assert sources.csv_files.infer_types(texts.where("k is null")).dtypes == [("k", "double")]
    # One number per cell and type list: the bits of a column are combined, not a truth value per type.
    assert spark.createDataFrame([("7",), ("-7",), ("x",), ("i",)], "cell string").selectExpr(
        f"collect_list({sources.csv_files._FITS}) as bits"
    ).first()["bits"] == [7, 5, 0, 0]

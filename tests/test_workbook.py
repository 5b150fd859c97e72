"""Workbooks written here by hand: sheets, headers on some row, dates, strings, damaged cells."""

import zipfile
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import forecast, labels, serving
from terrafold.sources import workbook
from terrafold.sources.readers import RATE_HEADERS

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def letters(k):
    return (letters(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)


def write_xlsx(path, sheets, later=False):
    """``sheets``: name -> rows; None, numbers, booleans, dates, ("shared", text) or text (inline)."""
    shared, parts = [], {}
    for n, rows in enumerate(sheets.values(), 1):
        body = []
        for r, row in enumerate(rows, 1):
            cells = []
            for c, v in enumerate(row):
                ref = f'r="{letters(c)}{r}"'
                if isinstance(v, tuple):
                    shared.append(v[1])
                    cells.append(f'<c {ref} t="s"><v>{len(shared) - 1}</v></c>')
                elif isinstance(v, bool):
                    cells.append(f'<c {ref} t="b"><v>{int(v)}</v></c>')
                elif isinstance(v, date):
                    cells.append(f'<c {ref} s="1"><v>{(v - (date(1904, 1, 1) if later else date(1899, 12, 30))).days}</v></c>')
                elif isinstance(v, (int, float)):
                    cells.append(f'<c {ref}><v>{v}</v></c>')
                elif v == "#N/A":
                    cells.append(f'<c {ref} t="e"><v>#N/A</v></c>')
                elif v is not None:
                    cells.append(f'<c {ref} t="inlineStr"><is><r><t>{v}</t></r></is></c>')
            body.append(f'<row r="{r}">{"".join(cells)}</row>')
        parts[f"xl/worksheets/sheet{n}.xml"] = f"<worksheet {NS}><sheetData>{''.join(body)}</sheetData></worksheet>"
    names = "".join(f'<sheet name="{s}" sheetId="{n}" r:id="rId{n}"/>' for n, s in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'<workbook {NS}><workbookPr date1904="{int(later)}"/><sheets>{names}</sheets></workbook>'
    rels = "".join(f'<Relationship Id="rId{n}" Target="worksheets/sheet{n}.xml" Type="x"/>' for n in range(1, len(sheets) + 1))
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>'
    parts["xl/styles.xml"] = f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="dd\\-mm\\-yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>'
    if shared:
        parts["xl/sharedStrings.xml"] = f"<sst {NS}>{''.join(f'<si><t>{s}</t></si>' for s in shared)}</sst>"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("books")
    write_xlsx(path / "2023.xlsx", {
        "January": [[("shared", "Date"), "O/N", "1M", "3 Months "], [date(2023, 1, 2), 4.1, 4.2, 4.3], ["03-01-2023", 4.4, None, 4.5], [None, 9, 9, 9], ["Date", "O/N", "1M", "3M"]],
        "February": [["Rates of the month"], [], [None, "note"], [None, "التاريخ", "3 أشهر"], [None, date(2023, 2, 1), 5.0], [None, date(1990, 2, 1), 1.0]],
        "Empty": [], "No header": [["a", "b"], [1, 2]],
    })
    (path / "deep").mkdir()
    write_xlsx(path / "deep" / "2024.xlsx", {"All": [["Date", "3 Month", "x"], [date(2024, 5, 6), 6.5, True], [date(2023, 1, 2), 7.7, "#N/A"]]}, later=True)
    (path / "notes.txt").write_text("no workbook")
    return str(path)


def test_a_partition_per_sheet(spark, folder):
    cells = workbook.read(spark, folder)
    assert cells.rdd.getNumPartitions() == 5
    got = {(r["path"].rsplit("/", 1)[1], r["sheet"], r["row"]): r["cells"] for r in cells.collect()}
    assert got["2023.xlsx", "January", 1] == ["Date", "O/N", "1M", "3 Months "] and got["2023.xlsx", "January", 2] == ["2023-01-02", "4.1", "4.2", "4.3"]
    assert got["2023.xlsx", "January", 3] == ["03-01-2023", "4.4", None, "4.5"] and ("2023.xlsx", "February", 2) not in got
    assert got["2024.xlsx", "All", 2] == ["2024-05-06", "6.5", "TRUE"] and got["2024.xlsx", "All", 3] == ["2023-01-02", "7.7", None]
    assert workbook.read(spark, f"{folder}/2023.xlsx", "February").select("sheet").distinct().collect()[0][0] == "February"


def test_headers_are_found_on_executors(spark, folder):
    cells = workbook.read(spark, folder)
    found = {(r["path"].rsplit("/", 1)[1], r["sheet"]): r["header"] for r in workbook.header_rows(cells, RATE_HEADERS, ("date", "3_month")).collect()}
    assert found == {("2023.xlsx", "January"): 1, ("2023.xlsx", "February"): 4, ("2024.xlsx", "All"): 1}
    table = workbook.sheet_table(cells, RATE_HEADERS, ("date", "3_month"), ["date", "overnight", "3_month"])
    rows = sorted((r["sheet"], r["date"], r["overnight"], r["3_month"]) for r in table.collect() if r["sheet"] != "All")
    assert rows == [("February", "1990-02-01", None, "1.0"), ("February", "2023-02-01", None, "5.0"), ("January", "03-01-2023", "4.4", "4.5"), ("January", "2023-01-02", "4.1", "4.3")]


def test_rates_of_all_sheets(spark, folder):
    got = {str(r["date"]): (r["overnight"], r["3_month"]) for r in workbook.rates(spark, folder).collect()}
    # The file that sorts last says it for a day that several have.
    assert got == {"2023-01-02": (None, 7.7), "2023-01-03": (4.4, 4.5), "2023-02-01": (None, 5.0), "2024-05-06": (None, 6.5)}


def test_title_rows(spark, tmp_path):
    write_xlsx(tmp_path / "v.xlsx", {"S": [["About"], ["x", "البيان", "Title"], ["a", 1], [], ["Source: someone"], ["b", 2]], "T": [["no"], ["title"]]})
    out = workbook.titled_rows(workbook.read(spark, str(tmp_path)))
    assert sorted((r["sheet"], r["row"], r["cells"][0]) for r in out.collect()) == [("S", 3, "a"), ("S", 6, "b")]


def months(spark, n, key="a", values=None):
    v = values or [100.0 + (k * 7) % 13 for k in range(n)]
    rows = [(key, f"{2015 + k // 12}-{k % 12 + 1:02d}-01", v[k]) for k in range(n)]
    return spark.createDataFrame(rows, "k string, m string, v double").withColumn("m", F.to_date("m"))


def test_walk_forward_equals_a_loop(spark):
    df = months(spark, 60).unionByName(months(spark, 44, "short")).unionByName(months(spark, 20, "new"))
    ends = ["2017-06-01", "2018-12-01", "2019-06-01"]
    got = {(r["k"], r["fold"], str(r["m"])): (r["status"], r["low"], r["median"], r["high"], r["actual"]) for r in forecast.walk_forward(df, ["k"], "m", "v", ends).collect()}
    rows = [(r["k"], r["m"], r["v"]) for r in df.collect()]
    want, seen = {}, 0
    for fold, end in enumerate(map(date.fromisoformat, ends)):
        for k in ("a", "short", "new"):
            past = [v for _, m, v in sorted(r for r in rows if r[0] == k) if m <= end]
            ahead = [(m, v) for _, m, v in sorted(r for r in rows if r[0] == k) if end < m <= date(end.year + 1, end.month, 1)]
            status = "insufficient history" if len(past) < 24 else "insufficient future" if len(ahead) < 12 else "ok"
            found = forecast.smoother(np.array(past), 12) if status == "ok" else np.full((12, 3), np.nan)
            for step, (m, v) in enumerate(ahead):
                values = tuple(pytest.approx(x) if x == x else None for x in found[step])
                want[k, fold, str(m)] = (status, *values, v)
                seen += status == "ok"
    assert got == want and seen == 36
    errors = {r["fold"]: r["rows"] for r in forecast.fold_errors(forecast.walk_forward(df, ["k"], "m", "v", ends)).collect()}
    assert errors == {0: 24, 1: 12}


def test_smoother():
    flat = forecast.smoother(np.full(30, 7.0), 3)
    assert flat.tolist() == [[7.0] * 3] * 3
    rising = forecast.smoother(np.arange(40, dtype=float), 12)
    assert (np.diff(rising[:, 1]) > 0).all() and (rising[:, 0] <= rising[:, 1]).all() and (rising[:, 1] <= rising[:, 2]).all()
    widths = forecast.smoother(np.array([1.0, 5.0] * 20), 4)
    assert (np.diff(widths[:, 2] - widths[:, 0]) > 0).all()


def test_batch_forecast(spark):
    out = forecast.batch_forecast(months(spark, 30).unionByName(months(spark, 10, "new")), ["k"], "m", "v").collect()
    assert len(out) == 24 and {(r["k"], r["status"]) for r in out} == {("a", "ok"), ("new", "insufficient history")}
    assert min(str(r["m"]) for r in out if r["k"] == "a") == "2017-07-01" and all(r["median"] is None for r in out if r["k"] == "new")


def test_area_cascade_with_its_fuzzy_steps(spark):
    from terrafold.functions import fuzzy

    shorts = [("JVC", "Al Barsha South Fourth"), ("Jumeirah Lakes Towers", "Al Thanyah Fifth"), ("Water Canal", "Business Bay"), ("Marina Walk", "Marsa Dubai")]
    doubt = [("Water Canal", "Al Wasl"), ("Old Town", "Burj Khalifa")]
    known = ["Business Bay", "Marsa Dubai", "Al Barsha South Fourth", "Palm Jumeirah", "Burj Khalifa"]
    asked = ["jvc ", "Jumeirah Lake Towers", "old town", "Watr Canal", "palm jumeirah", "Palm Jumera", "Busines Bay", "Nowhere at all", "", None, "MARINA WALK", "qq"]

    def expected(name):
        if not name:
            return None, 0.0, "none"
        flat = name.strip().lower()
        for a, v in shorts:
            if a.lower() == flat:
                return v, 100.0, "abbrev"
        for a, v in doubt:
            if a.lower() == flat:
                return v, 60.0, "ambiguous"
        score, alias = min((-fuzzy.wratio(name.upper(), a.upper()), a) for a, _ in shorts)
        if -score >= 85:
            return (dict(doubt)[alias], 60.0, "ambiguous") if alias in dict(doubt) else (dict(shorts)[alias], -score, "abbrev_fuzzy")
        for a in known:
            if a.lower() == flat:
                return a, 100.0, "exact"
        score, area = min((-fuzzy.wratio(name.upper(), a.upper()), a) for a in known)
        return (area, -score, "fuzzy") if -score >= 70 else (name, 50.0, "fallback")

    req = spark.createDataFrame([(k, n) for k, n in enumerate(asked * 2)], "id int, area string")
    pairs = lambda rows, c: spark.createDataFrame(rows, f"alias string, {c} string")
    out = labels.resolve_areas(req, "area", pairs(shorts, "area"), spark.createDataFrame([(a,) for a in known], "area string"), pairs(doubt, "dominant"))
    got = {r["id"]: (r["area_value"], pytest.approx(r["area_confidence"]), r["area_method"]) for r in out.collect()}
    assert got == {k: expected(n) for k, n in enumerate(asked * 2)}
    assert {m for _, _, m in map(expected, asked)} == {"none", "abbrev", "ambiguous", "abbrev_fuzzy", "exact", "fuzzy", "fallback"}


def test_developer_cascade_with_its_fuzzy_step(spark):
    mapping = spark.createDataFrame([("Emaar", "إعمار", ["Emaar Properties"]), ("Damac", "داماك", None), ("Sobha Realty", "شوبا", ["Sobha"])], "english string, arabic string, aliases array<string>")
    req = spark.createDataFrame([(n,) for n in ("EMAAR ", "emaar properties", "Sobah", "Damacc", "Zzyzx", "", None)], "developer string")
    got = {r["developer"]: (r["developer_value"], r["developer_native"], r["developer_method"]) for r in labels.resolve_developers(req, "developer", mapping).collect()}
    assert got == {
        "EMAAR ": ("Emaar", "إعمار", "exact"), "emaar properties": ("Emaar", "إعمار", "alias"), "Sobah": ("Sobha Realty", "شوبا", "fuzzy"), "Damacc": ("Damac", "داماك", "fuzzy"),
        "Zzyzx": ("Zzyzx", "Unknown", "unknown"), "": (None, None, "none"), None: (None, None, "none"),
    }


def test_matches_of_names(spark):
    known = spark.createDataFrame([(n,) for n in ("Emaar", "Emaar Properties", "Damac", None, "")], "developer_name string")
    req = spark.createDataFrame([(n,) for n in ("Emaar", "maar Prop", "The Damac Group", "Damoc", "unknown", "", None, "Xq")], "d string")
    got = {r["name"]: (r["matched"], r["method"]) for r in serving.match_developers(req, "d", known).collect()}
    assert got == {"Emaar": ("Emaar", "exact"), "maar Prop": ("Emaar Properties", "substring"), "The Damac Group": ("Damac", "substring"), "Damoc": ("Damac", "fuzzy")}
    areas = spark.createDataFrame([("Business Bay",), ("Marina",)], "area_name string")
    asked = spark.createDataFrame([("business bay",), ("Busines Bay",), ("qqqq",)], "a string")
    assert {r["name"]: (r["matched"], r["method"]) for r in serving.match_areas(asked, "a", areas).collect()} == {"business bay": ("Business Bay", "exact"), "Busines Bay": ("Business Bay", "fuzzy")}

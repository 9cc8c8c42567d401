import datetime as dt
import json
import zipfile

import pytest

from tidemark.sources import archives, feeds, fixed_width, workbooks
from tidemark.sources.archives import FormatError
from tidemark.sources.store import StaleError, Store, StoreError, resolve_root


def record(session="20240102", ticker="PETR4", market="010", company="PETROBRAS", currency="R$", factor=1, isin="BRPETRACNPR6", price=38.5):
    line = [" "] * fixed_width.RECORD

    def put(name, text):
        a, b = fixed_width.FIELDS[name]
        line[a - 1 : b] = list(str(text).ljust(b - a + 1)[: b - a + 1])

    line[0:2] = "01"
    for name, (a, b) in fixed_width.FIELDS.items():
        if name in fixed_width.PRICES:
            put(name, f"{round(price * 100):0{b - a + 1}d}")
    for name, value in {"trades": 12, "volume_shares": 500, "traded_value": 123456, "quotation_factor": factor, "distribution_number": 101, "bdi_code": 2}.items():
        a, b = fixed_width.FIELDS[name]
        put(name, f"{value:0{b - a + 1}d}")
    for name, value in {"session_date": session, "ticker": ticker, "market_type": market, "company_name": company, "specification": "PN      N2", "currency": currency, "isin": isin}.items():
        put(name, value)
    return "".join(line)


def archive(folder, lines, year=2024, count=None, wrap=True, encoding="latin-1"):
    if wrap:
        n = len(lines) + 2 if count is None else count
        head = f"00COTAHIST.{year}BOVESPA 20250102".ljust(245)
        lines = [head, *lines, f"99COTAHIST.{year}BOVESPA 20250102{n:011d}".ljust(245)]
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"COTAHIST_A{year}.ZIP"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("DATA.TXT", b"".join(line.encode(encoding) + b"\r\n" for line in lines))
    return str(path)


def test_annual_records(spark, tmp_path):
    lines = [record(), record(ticker="VALE3", factor=1000, isin="BRVALEACNOR0"), record(market="030"), record(session="19940630", ticker="OLD3")]
    rows = fixed_width.read_annual(spark, [archive(tmp_path, lines)]).orderBy("ticker").collect()
    assert [(r.ticker, r.close, r.traded_value, r.market_type) for r in rows] == [("PETR4", 38.5, 1234.56, 10), ("VALE3", 0.0385, 1234.56, 10)]
    assert rows[0].session_date == dt.date(2024, 1, 2) and rows[0].distribution_number == 101


def test_utf8_lines_are_repaired(spark, tmp_path):
    path = archive(tmp_path, [record(company="AÇÃO")], encoding="utf-8")
    assert fixed_width.read_annual(spark, [path]).first().company_name == "AÇÃO"
    assert fixed_width.file_report(fixed_width.read_lines(spark, [path])).first().rows_repaired == 1


@pytest.mark.parametrize(
    "case,said",
    [
        (dict(lines=[record()], count=9), "trailer counts"),
        (dict(lines=[record(), "00".ljust(245)]), "one header"),
        (dict(lines=[record()], wrap=False), "one header"),
        (dict(lines=[record()[:200]]), "wrong length"),
        (dict(lines=["07".ljust(245)]), "unknown record"),
        (dict(lines=[record(), record()]), "repeated key"),
    ],
)
def test_broken_annual_files(spark, tmp_path, case, said):
    with pytest.raises(FormatError, match=said):
        fixed_width.read_annual(spark, [archive(tmp_path, **case)])


@pytest.mark.parametrize("bad,said", [(record(factor=0), "factor"), (record(currency="US$"), "currency"), (record()[:60] + "x" + record()[61:], "no number")])
def test_broken_records(spark, tmp_path, bad, said):
    with pytest.raises(Exception, match=said):
        fixed_width.read_annual(spark, [archive(tmp_path, [bad])]).collect()


def test_trailer_may_count_details_only(spark, tmp_path):
    report = fixed_width.file_report(fixed_width.read_lines(spark, [archive(tmp_path, [record()], count=1)])).first()
    assert report.trailer_counts == "detail_records" and report.problem is None


def test_credits(spark, tmp_path):
    a, b, c = (tmp_path / n for n in ("2024-03-05.csv", "2024-04-06.csv", "2024-05-07.csv"))
    a.write_text("x\nIssuer;Code;Type;Approved;Value;Credit\nPETRO;BRPETRACNPR6 101;dividend;01/02/2024;1.25;03/05/2024\n", "utf-8")
    b.write_text("Emissor;Código;Tipo;Aprovado;Valor;Crédito\nVALE;BRVALEACNOR0  99;JRS;-;1.234,5;06/04/2024\nshort;row\n", "utf-8")
    rows = feeds.read_credits(spark, [str(a), str(b)]).orderBy("issuer").collect()
    assert [(r.isin, r.distribution_number, r.label, r.value, r.approved_on) for r in rows] == [
        ("BRPETRACNPR6", 101, "DIVIDEND", 1.25, dt.date(2024, 2, 1)),
        ("BRVALEACNOR0", 99, "JRS", 1234.5, None),
    ]
    c.write_text("Issuer;a;b;c;d;e\nX;BR 1;d;-;1;01/01/2024\n")
    with pytest.raises(Exception, match="another credit date"):
        feeds.read_credits(spark, [str(c)]).collect()


def test_company_answers(spark, tmp_path):
    cash = {"isinCode": "BRX", "label": "DIV", "rate": "0,50", "lastDatePrior": "05/03/2024", "approvedOn": "31/12/9999", "paymentDate": "", "relatedTo": "2023"}
    stock = {"isinCode": "BRX", "assetIssued": None, "label": "SPLIT", "factor": "1.000,00", "lastDatePrior": "2024-01-02"}
    paths = []
    for snap in ("2024-01-31", "2024-02-29"):
        p = tmp_path / snap / "supplement" / "XPTO.json"
        p.parent.mkdir(parents=True)
        p.write_text(json.dumps([{"cashDividends": [cash, cash] if snap < "2024-02" else [cash], "stockDividends": [stock], "subscriptions": None}]))
        paths.append(str(p))
    found = feeds.read_supplements(spark, paths)
    assert sorted((r.snapshot.isoformat(), r.cash_amount, r.approved_on) for r in found["cash_recent"].collect()) == [("2024-01-31", 0.5, None), ("2024-02-29", 0.5, None)]
    only = found["stock"].collect()
    assert [(r.factor, r.target_isin, r.last_cum_date, r.snapshot.isoformat()) for r in only] == [(1000.0, "", dt.date(2024, 1, 2), "2024-02-29")]
    assert found["subscriptions"].count() == 0
    item = {"typeStock": "ON", "corporateAction": "DIV", "valueCash": "10,00", "quotedPerShares": "1000", "lastDatePriorEx": "05/03/2024", "closingPricePriorExDate": "2.000,0"}
    pages = []
    for name in ("page-001", "page-OLD-001"):
        p = tmp_path / "2024-02-29" / "cash_dividends" / "XPTO" / f"{name}.json"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(json.dumps({"results": [item, item] if name == "page-001" else [item]}))
        pages.append(str(p))
    rows = feeds.read_cash_pages(spark, pages).collect()
    assert [(r.code, r.cash_amount, r.closing_price) for r in rows] == [("XPTO", 0.01, 2.0)] * 2


def zipped(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(f"{name}.csv", text.encode("latin-1"))
    return str(path)


def test_registration_forms(spark, tmp_path):
    text = "CNPJ_Companhia;Data_Referencia;Codigo_Negociacao\n1;2020-01-01; petr4 \n1;2020-05-01;PETR4\n2;2021-01-01;\n"
    path = zipped(tmp_path / "fca_cia_aberta_2020.zip", fca_cia_aberta_valor_mobiliario_2020=text, other="a;b\n")
    assert [tuple(r) for r in archives.reference_securities(spark, [path]).collect()] == [(2020, "PETR4", "1")]
    bad = zipped(tmp_path / "b.zip", fca_cia_aberta_valor_mobiliario_2021="CNPJ_Companhia;Data_Referencia\n1;2020-01-01\n")
    with pytest.raises(Exception, match="no column Codigo_Negociacao"):
        archives.reference_securities(spark, [bad]).collect()


def test_share_counts(spark, tmp_path):
    event = "ID_Capital_Social_Desdobramento"
    head = ["CNPJ_Companhia", "Nome_Companhia", event, "Data_Aprovacao", "Tipo_Evento"] + [
        f"Quantidade_Acoes_{k}_{n}_Aprovacao" for k in ("Ordinarias", "Preferenciais") for n in ("Antes", "Depois")
    ]
    a = ";".join(head) + "\n1;Cia;7;2020-02-03;Desdobramento;100;200;50;100\n1;Cia;8;;Grupamento;1;2;3;4\n"
    b = f"{event};Tipo_Classe_Acao_Preferencial;Quantidade_Acoes_Antes_Aprovacao;Quantidade_Acoes_Depois_Aprovacao\n7;Preferencial Classe A;10;20\n7;Outra;1;2\n"
    path = zipped(tmp_path / "fre_cia_aberta_2020.zip", fre_cia_aberta_capital_social_desdobramento_2020=a, fre_cia_aberta_capital_social_desdobramento_classe_acao_2020=b)
    rows = archives.share_count_events(spark, [path]).orderBy("share_class").collect()
    assert [(r.share_class, r.shares_before, r.shares_after, r.approved_on) for r in rows] == [
        (c, x, y, dt.date(2020, 2, 3)) for c, x, y in (("ON", 100.0, 200.0), ("PN", 50.0, 100.0), ("PNA", 10.0, 20.0))
    ]


def book(path, sheets):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'

    def cell(x):
        return "<c/>" if x is None else f'<c t="inlineStr"><is><t>{x}</t></is></c>' if isinstance(x, str) else f"<c><v>{x}</v></c>"

    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f"<workbook {ns} {rel}><sheets>{names}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return str(path)


def test_workbooks(spark, tmp_path):
    title = "3ª Prévia do IBOVESPA para Setembro a Dezembro de 2017"
    rows = [[title], ["CÓDIGO"], ["PETR4", "PETROBRAS", "PN", 100.0, 5.5], ["VALE3", "VALE", "ON", 50.0, 4.5], ["Pregão Base:", 42975.0]]
    path = book(tmp_path / "w.xlsx", {"IBOV": rows, "IBRX": rows[:4], "notes": [["x"]]})
    got = workbooks.read_workbook(spark, path).collect()
    assert {(r["index"], r.ticker) for r in got} == {(i, t) for i in ("IBOV", "IBXX") for t in ("PETR4", "VALE3")}
    assert {(r.period, r.source, r.base_session) for r in got} == {("2017-09", "third_preview", dt.date(2017, 8, 28))}
    for bad in ({"X": rows}, {"IBOV": [["no title"], *rows[1:]]}, {"IBOV": rows[:3]}, {"IBOV": rows, "IBRX": rows, "IBXX": rows[:3]}):
        with pytest.raises(FormatError):
            workbooks.read_workbook(spark, book(tmp_path / "bad.xlsx", bad))
    assert workbooks.read_title("Virada da carteira para Maio de 2020").source == "definitive"
    for title, kind, period in (
        ("2a  PRÉVIA - Carteira para janeiro a abril de 2019", "second_preview", "2019-01"),
        ("Terceira prévia para Maio a Agosto de 2021", "third_preview", "2021-05"),
        ("2ª Prévia do IBrX para Setembro de 2008", "second_preview", "2008-09"),
    ):
        assert workbooks.read_title(title) == workbooks.Title(kind, period)
    for odd in (
        "1ª prévia para Maio de 2020", "2ª prévia, virada para Maio de 2020", "Virada para Junho de 2020", "Virada para Maio e Junho de 2020",
        "Virada para Maio de 20", "Virada de Maio", "",
    ):
        with pytest.raises(FormatError):
            workbooks.read_title(odd)


def test_compositions(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("period,ticker,name,share_class,weight_pct\n2003-01,PETR4,P,PN,5.5\n2003-05, VALE3 ,V,ON,1\n")
    assert sorted(r.ticker for r in feeds.read_compositions(spark, str(p)).collect()) == ["PETR4", "VALE3"]
    p.write_text("period,ticker,name,share_class,weight_pct\n2003-02,PETR4,P,PN,5.5\n2003-01,VALE3,V,ON,z\n")
    with pytest.raises(FormatError, match="malformed period"):
        feeds.read_compositions(spark, str(p))


def test_a_replacement_that_fails_keeps_the_table(spark, tmp_path, monkeypatch):
    from tidemark.sources import files

    store = Store.initialize(f"file://{tmp_path}")
    store.replace(spark.range(3), "curated", "t")
    real = files.HadoopFiles.rename

    def failing(self, old, new):
        return False if old.endswith(".new") else real(self, old, new)

    monkeypatch.setattr(files.HadoopFiles, "rename", failing)
    with pytest.raises(StoreError, match="could not take the place"):
        store.replace(spark.range(5), "curated", "t")
    assert store.read(spark, "curated", "t").count() == 3
    # A crash between the two renames leaves the old table aside.
    monkeypatch.undo()
    (tmp_path / "curated" / "t").rename(tmp_path / "curated" / "t.old")
    assert store.read(spark, "curated", "t").count() == 3
    store.replace(spark.range(5), "curated", "t")
    assert store.read(spark, "curated", "t").count() == 5 and not (tmp_path / "curated" / "t.old").exists()
    assert store.path("raw", "a", "b").startswith("file:///") and Store.open(f"file://{tmp_path}").root == store.root


def test_store(spark, tmp_path):
    with pytest.raises(StoreError):
        Store.open(str(tmp_path))
    store = Store.initialize(str(tmp_path))
    for bad in (("raw", "..", "x"), ("raw", "/x"), ("other", "x")):
        with pytest.raises(StoreError):
            store.path(*bad)
    for n in (3, 5):
        store.replace(spark.range(n), "curated", "t")
        assert store.read(spark, "curated", "t").count() == n
    rows = spark.createDataFrame([(2020, 1), (2021, 1)], "year int, x int")
    store.replace_partitions(rows, "year", "curated", "bars")
    store.replace_partitions(spark.createDataFrame([(2021, 7)], "year int, x int"), "year", "curated", "bars")
    assert sorted((r.year, r.x) for r in store.read(spark, "curated", "bars").collect()) == [(2020, 1), (2021, 7)]
    store.stamp({"a": "1"}, "derived", "f")
    store.require_fresh({"a": "1"}, "derived", "f")
    with pytest.raises(StaleError):
        store.require_fresh({"a": "2"}, "derived", "f")


def test_roots(tmp_path, monkeypatch):
    monkeypatch.delenv("TIDEMARK_ROOT", raising=False)
    config = tmp_path / "c.toml"
    config.write_text('root = "/data/lake"\n')
    assert resolve_root("/x", config=str(config)) == "/x"
    assert resolve_root(config=str(config)) == "/data/lake"
    monkeypatch.setenv("TIDEMARK_ROOT", "relative")
    with pytest.raises(StoreError):
        resolve_root()

"""CSV lots: parts that begin inside cells, headers as data, and files that cannot be read."""

from __future__ import annotations

import csv
import gzip
import io

import pytest

from textlots.sources import csv_lots
from textlots.sources.csv_lots import cells_of, ends_inside, read_csv_lot, read_rows


@pytest.mark.parametrize("line,outside,inside", [
    ("a,b", False, True), ('a,"b"', False, False), ('a,"b', True, False), ('b",c', False, False), ('"a""b",c', False, False),
    ('""', False, True), ('5" wide,b', False, False), ('"a,b', True, False), ('x"",y', False, True), ('",', True, False), ("", False, True),
])
def test_ends_inside(line, outside, inside):
    assert (ends_inside(line, False), ends_inside(line, True)) == (outside, inside)


def whole(text):
    """Every record by Python's reader of the whole text."""
    return [[cell or None for cell in row] for row in csv.reader(io.StringIO(text, newline="")) if row]


def hard_text(n=3000):
    lines = ["id,comentario,nota"]
    for i in range(n):
        cell = ["sin comillas", '"con, coma"', '"dos\nlíneas"', '"cita ""doble"", y\n\n más"', '5" de ancho', '""', ""][i % 7]
        lines.append(f"{i},{cell},{'x' * (i % 40)}")
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_many_tasks_read_one_file_with_line_breaks(spark, tmp_path, ending):
    text = hard_text()
    path = tmp_path / "a.csv"
    path.write_bytes(text.replace("\n", ending).encode() if ending == "\r\n" else text.encode())
    confs = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1k"}
    before = {name: spark.conf.get(name) for name in confs}
    try:
        for name, value in confs.items():
            spark.conf.set(name, value)
        assert csv_lots._lines(spark, [str(path)]).rdd.getNumPartitions() > 20
        starts = csv_lots.inside_starts(csv_lots._lines(spark, [str(path)]))
        assert starts
        rows = read_rows(spark, [str(path)]).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len({r.row_no for r in rows}) == len(rows)
    want = whole(text)
    got = [[c and c.replace("\r\n", "\n") for c in r.cells] for r in sorted(rows, key=lambda r: r.row_no)]
    assert got == [[c and c.replace("\r\n", "\n") for c in row] for row in want]


def test_a_cell_longer_than_parts(spark, tmp_path):
    cell = "muy largo, con \"\"citas\"\"\n" * 2000
    (tmp_path / "a.csv").write_text(f'id,comentario\n1,"{cell}"\n2,Texto corto pero bueno\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = read_rows(spark, [str(tmp_path / "a.csv")]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(len(r.cells[1]) for r in rows) == sorted([len("comentario"), len(cell.replace('""', '"')), 22])


def test_cells_of():
    assert cells_of('a,,"b ""c""\nd",') == ["a", None, 'b "c"\nd', None]
    assert cells_of("a,b") == ["a", "b"]


def test_bad_files_are_error_rows(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"good{i}.csv").write_text(f"id,comentario\n1,El texto bueno número {i}.\n")
    packed = gzip.compress("".join(f"{i},Texto número {i} de la lista.\n" for i in range(20_000)).encode())
    (tmp_path / "cut.csv.gz").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "numbers.csv").write_text("a,b\n1,2\n3,4\n")
    texts, status = read_csv_lot(spark, [str(tmp_path)])
    assert sorted(r.text for r in texts.collect()) == [f"El texto bueno número {i}." for i in range(6)]
    errors = {r.source: r.error for r in status.collect()}
    assert len(errors) == 8 and errors["numbers.csv"] == "no text column found in numbers.csv"
    assert errors["cut.csv.gz"] and sum(error is None for error in errors.values()) == 6
    with pytest.raises(Exception):
        read_csv_lot(spark, [str(tmp_path)], isolate=False)


def test_bad_files_cost_a_few_reads():
    from pyspark.errors import PySparkException

    reads = []

    def read(some):
        reads.append(some)
        if "f77" in some:
            raise PySparkException("damaged")
        return some

    names = [f"f{i:02d}" for i in range(100)]
    made, errors = csv_lots.read_each(["*"], lambda some: read(names if some == ["*"] else some), lambda: names)
    assert sorted(sum(made, [])) == [name for name in names if name != "f77"] and list(errors) == ["f77"]
    assert len(reads) < 18


def test_bad_parquet_file(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
    file = next((tmp_path / "p1").glob("*.parquet"))
    file.write_bytes(file.read_bytes()[: file.stat().st_size // 2])
    folders = [str(tmp_path / f"p{i}") for i in range(3)]
    made, errors = csv_lots.read_each(
        folders, lambda some: csv_lots.settled(spark.read.schema("id bigint").parquet(*some)), lambda: folders
    )
    assert sorted(row.id for part in made for row in part.collect()) == [*range(10), *range(20, 30)]
    assert [path.rsplit("/", 1)[-1] for path in errors] == ["p1"]


def test_many_headers_take_the_same_jobs(spark, tmp_path):
    counts = {}
    for n in (3, 60):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            (folder / f"f{i}.csv").write_text(f"id{i},nota_{i},otro{i}\n{i},El texto de la nota {i}.,x\n")
        (folder / "bare.csv").write_text("7,Un texto sin cabecera alguna.\n")
        spark.sparkContext.setJobGroup(f"headers {n}", "count")
        texts, status = read_csv_lot(spark, [str(folder)])
        found = {r.source: r.column_detected for r in status.collect()}
        assert texts.count() == n + 1
        counts[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"headers {n}"))
        assert found == {**{f"f{i}.csv": f"nota_{i}" for i in range(n)}, "bare.csv": "col_1"}
    assert counts[60] <= counts[3] + 2


def test_empty_and_odd_files(spark, tmp_path):
    (tmp_path / "only.csv").write_text("id,nota\n")
    (tmp_path / "open.csv").write_text('id,comentario\n1,"Un texto que nunca se cierra\ny sigue así')
    (tmp_path / "short.csv").write_text("id,comentario,z\n1\n2,Este texto de aquí está completo.\n\n3,Y este otro también lo está.,9,8,7\n")
    texts, status = read_csv_lot(spark, [str(tmp_path)])
    assert sorted(r.text for r in texts.collect()) == [
        "Este texto de aquí está completo.", "Un texto que nunca se cierra y sigue así", "Y este otro también lo está."]
    assert {r.source: r.n_texts for r in status.collect()} == {"only.csv": 0, "open.csv": 1, "short.csv": 2}

"""Reading lots: nothing is lost on quotes, line breaks, other headers or broken lines."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from textlots.sources import files


def texts_of(frame):
    return sorted(r.text for r in frame.collect())


def test_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,comentario\n1,"Dijo ""no funciona"", y se fue."\n2,"Primera línea,\nsegunda línea."\n3,Sin comillas aquí.\n')
    texts, detected = files.read_feedback(spark, [str(path)])
    assert texts_of(texts) == ['Dijo "no funciona", y se fue.', "Primera línea, segunda línea.", "Sin comillas aquí."]
    assert detected.first().column_detected == "comentario"


def test_own_results_come_back(spark, tmp_path):
    rows = [("lot", 'Un "texto" citado, con coma.'), ("lot", "Dos líneas\nen una celda."), ("lot", 'Barra \\" y comilla final "')]
    files.write_results(spark.createDataFrame(rows, "batch_id string, texto string"), str(tmp_path / "out"), "csv")
    texts, _ = files.read_feedback(spark, [str(tmp_path / "out" / "batch_id=lot")])
    assert texts_of(texts) == sorted(" ".join(t.split()) for _, t in rows)


def test_sink_deals_tasks_by_size(spark, tmp_path):
    rows = [("big", "x" * 100)] * 3000 + [(f"lot{i % 40}", f"texto {i}" + "y" * 90) for i in range(5900)] + [(None, "z" * 100)] * 100
    table = spark.createDataFrame(rows, "batch_id string, texto string").repartition(16)
    target = 40_000
    files.write_results(table, str(tmp_path / "out"), target_bytes=target)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, back.select("batch_id", "texto").collect())) == sorted(map(repr, table.collect()))
    written = list((tmp_path / "out").rglob("*.parquet"))
    assert len(written) <= 9000 * 110 / target + 42 + 1
    # Rows of the large lot are all equal, and still in many files of like size.
    sizes = [r.n for r in back.where("batch_id = 'big'").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 7 and max(sizes) < 600
    files.write_results(table.limit(0), str(tmp_path / "none"))


def test_each_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,comentario\n1,El primero es bueno.\n")
    (tmp_path / "b.csv").write_text("comentario,id\nEl segundo no carga.,22222222222222222\n")
    (tmp_path / "c d.csv").write_text("x,_contenido,y\n1,El tercero tarda mucho.,2\n")
    texts, detected = files.read_feedback(spark, [str(tmp_path / "*.csv")])
    assert texts_of(texts) == ["El primero es bueno.", "El segundo no carga.", "El tercero tarda mucho."]
    found = {r.source: r.column_detected for r in detected.collect()}
    assert list(found.values()).count("comentario") == 2 and "_contenido" in found.values()


def test_files_without_header_beside_others(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,comentario\n1,El primero es bueno.\n")
    (tmp_path / "b.csv").write_text("El único texto, sin cabecera.\n".replace(",", ""))
    (tmp_path / "c.csv").write_text("1,2,Otro texto que está solo.\n")
    texts, _ = files.read_feedback(spark, [str(tmp_path / "*.csv")])
    assert texts_of(texts) == ["El primero es bueno.", "El único texto sin cabecera.", "Otro texto que está solo."]


def test_broken_json_lines_are_counted(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"texto": "Un texto json, bueno."}\n{"texto": \nnada\n')
    (tmp_path / "b.json").write_text('{"texto": "Otro texto json, bueno."}\n')
    texts, detected = files.read_feedback(spark, [str(tmp_path / "*.json")], "json")
    assert len(texts_of(texts)) == 2
    assert {r.source: r.broken_rows for r in detected.collect()} == {"a.json": 2, "b.json": 0}


def test_damaged_files_are_not_half_read(spark, tmp_path):
    packed = gzip.compress("".join(f"Texto número {i} de la lista.\n" for i in range(20_000)).encode())
    (tmp_path / "cut.csv.gz").write_bytes(packed[: len(packed) // 2])
    texts, detected = files.read_feedback(spark, [str(tmp_path / "cut.csv.gz")])
    assert texts.count() == 0 and detected.first().error
    with pytest.raises(Exception):
        files.read_cells(spark, [str(tmp_path / "cut.csv.gz")], "csv", "lot").count()


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet", "orc"])
def test_documents_round_trip(spark, small, tmp_path, fmt):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.trim("text").alias("texto"))
    folder = str(tmp_path / fmt)
    writer = docs.repartition(3).write.format(fmt)
    (writer.options(header=True, quoteAll=True, escape='"') if fmt == "csv" else writer).save(folder)
    cells = files.read_cells(spark, [folder], fmt, "lot")
    assert sorted((int(r.doc_id), r.texto) for r in cells.collect()) == sorted(map(tuple, docs.collect()))

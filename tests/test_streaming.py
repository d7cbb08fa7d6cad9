"""Incremental folder consolidation (Structured Streaming, availableNow)."""

from __future__ import annotations

import datetime as dt
import os

from ledgerkit.streaming.folder_stream import clean_ledger, start_folder_ingest

AS_OF = dt.date(2024, 6, 30)


def _write(folder, name, text):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as fh:
        fh.write(text)


def _rows(spark, landed):
    df = clean_ledger(spark, landed, AS_OF).df
    return sorted(map(tuple, df.select("montant", "date", "flux", "pme", "region", "source_file").collect()))


def test_new_files_are_landed_once(spark, workdir):
    landing, landed, ckpt = (os.path.join(workdir, d) for d in ("landing", "landed", "ckpt"))
    os.makedirs(landing)
    _write(landing, "engagements_nord.csv", "Montant;Date;Flux;PME\n10,5;01/01/2024;Vente;A\n20;02/01/2024;Achat;B\n")
    _write(landing, "notes.txt", "not a ledger")
    start_folder_ingest(spark, landing, landed, ckpt).awaitTermination(120)
    assert [r[:1] + r[4:5] for r in _rows(spark, landed)] == [(10.5, "Nord"), (20.0, "Nord")]

    _write(landing, "operations_sud.csv", "Montant,Date,Flux,PME\n5,03/01/2024,Vente,C\n")
    start_folder_ingest(spark, landing, landed, ckpt).awaitTermination(120)
    assert [r[0] for r in _rows(spark, landed)] == [5.0, 10.5, 20.0]  # the first file was not read again


def test_results_do_not_depend_on_the_trigger_size(spark, workdir):
    landing = os.path.join(workdir, "landing")
    os.makedirs(landing)
    _write(landing, "b_nord.csv", "Montant;Date;Flux;PME\n10;;Vente;A\n10;;Vente;A\n20;;Achat;B\n")
    _write(landing, "a_sud.csv", "Montant;Date;Flux;PME\n7;03/02/2024;Vente;C\n8;;Achat;D\n")
    results = []
    for size in (1, 1000):
        landed = os.path.join(workdir, f"landed{size}")
        start_folder_ingest(spark, landing, landed, os.path.join(workdir, f"ckpt{size}"), max_files_per_trigger=size).awaitTermination(120)
        results.append(_rows(spark, landed))
    assert results[0] == results[1] and len(results[0]) == 4
    assert {r[1] for r in results[0]} == {"2024-02-03"}

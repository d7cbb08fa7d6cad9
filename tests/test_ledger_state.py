"""Incremental consolidation: parts added batch by batch give what one pass over all files gives."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from ledgerkit import constants as K
from ledgerkit.operators.prepare import prepare
from ledgerkit.plans import profiles as P
from ledgerkit.plans.shared import build_shared
from ledgerkit.streaming import ledger_state as LS
from ledgerkit.streaming.folder_stream import clean_ledger, start_folder_ingest

AS_OF = dt.date(2024, 6, 30)

# Each step lands more files. The second has an earlier first date and a duplicate of a row that
# gets it; the third brings an exact alias for the amount and an optional column.
STEPS = [
    {"m_nord.csv": "Valeur;Date;Flux;PME\n10,5;01/03/2024;Vente;A\n10,5;01/03/2024;Vente;A\n20;;Achat;B\n7;02/03/2024;Achat;B\n7;;Achat;B\n30;15/04/2024;Credit;C\n"},
    {"a_sud.csv": "Valeur;Date;Flux;PME\n5;10/02/2024;Vente;C\n8;;Achat;D\n8;10/02/2024;Achat;D\n8;;Achat;D\n", "z_est.csv": "Valeur;Date;Flux;PME\n-4;03/03/2024;Paiement;A\n;;;\n"},
    {"n_ouest.csv": "Montant;Date;Flux;PME;Budget\n100;05/03/2024;Vente;E;90\n50,25;;Loan;F;60\n"},
    {"b_nord.csv": "Montant;Date;Flux;PME;Budget\n1;01/01/2024;Vente;G;2\n"},
]


def _land(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as fh:
            fh.write(text)


def _shown(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def _whole(spark, landed, by):
    cleaned = clean_ledger(spark, landed, AS_OF)
    if by is None:
        return cleaned.df, None
    p = prepare(cleaned.df, cleaned.mapping, LS.ORDER, AS_OF, by)
    shared = build_shared(p)
    return cleaned.df, sorted((tuple(r) for f in K.MONTHLY_PROFILES for r in P.build_profile(shared, f)["cards"].collect()), key=repr)


def test_parts_give_what_one_pass_gives(spark, workdir, monkeypatch):
    landing, landed, ckpt, root = (os.path.join(workdir, d) for d in ("in", "landed", "ckpt", "state"))
    cleaned_epochs = []
    real = LS.LedgerState._clean
    monkeypatch.setattr(LS.LedgerState, "_clean", lambda self, e, d: (cleaned_epochs.append(e), real(self, e, d))[1])
    seen = []
    for step, files in enumerate(STEPS):
        _land(landing, files)
        start_folder_ingest(spark, landing, landed, ckpt, state_dir=root).awaitTermination(300)
        seen.append(cleaned_epochs[:])
        cleaned_epochs.clear()
        state = LS.LedgerState(spark, landed, root)
        by = {1: (), 3: ("region_label",)}.get(step)
        rows, cards = _whole(spark, landed, by)
        assert _shown(state.ledger(AS_OF)) == _shown(rows)
        if cards:
            assert sorted(map(tuple, state.cards(AS_OF, by).collect()), key=repr) == cards
    # a batch is cleaned alone, unless it changes a role or an optional column: then all are
    assert seen == [[0], [1], [0, 1, 2], [3]]


def test_a_batch_may_be_added_again(spark, workdir):
    landing, landed, ckpt, root = (os.path.join(workdir, d) for d in ("in", "landed", "ckpt", "state"))
    _land(landing, STEPS[0])
    start_folder_ingest(spark, landing, landed, ckpt, state_dir=root).awaitTermination(300)
    state = LS.LedgerState(spark, landed, root)
    before = _shown(state.ledger(AS_OF))
    assert state.add(0) is False and _shown(state.ledger(AS_OF)) == before and state.epochs() == [0]


def test_decisions_survive_their_text():
    d = LS.Decision(("Montant", "x"), LS.ColumnMapping("montant", "date", "flux", "pme"), {"date": "date"}, {"budget": "x"})
    assert LS.decision_of(d.text()) == d and not d.changes(d)
    assert LS.Decision(("Montant", "x", "montant"), d.mapping, d.defaults, d.optional).changes(d) is False
    assert LS.Decision(d.columns, d.mapping, {}, d.optional).changes(d)


@pytest.mark.parametrize("text", ["Montant,Date\n5,01/01/2024\n"])
def test_a_ledger_without_undated_rows(spark, workdir, text):
    landing, landed, ckpt, root = (os.path.join(workdir, d) for d in ("in", "landed", "ckpt", "state"))
    _land(landing, {"a.csv": text})
    start_folder_ingest(spark, landing, landed, ckpt, state_dir=root).awaitTermination(300)
    state = LS.LedgerState(spark, landed, root)
    assert _shown(state.ledger(AS_OF)) == _shown(clean_ledger(spark, landed, AS_OF).df)

"""Shared fixtures: one local Spark session, UI off, a private checkpoint folder."""

from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ledgerkit.session import local_session

    session = local_session(shuffle_partitions=8)
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lk-test-ckpt-"))
    yield session


@pytest.fixture()
def workdir():
    return tempfile.mkdtemp(prefix="lk-test-")

"""Licence notices that go over several lines."""

import random
import textwrap

import pytest
from fixtures import prose

from tableprofile.llm import licence_scan

LONG = [(family, t) for family, all_ in licence_scan.TEMPLATES.items() for t in all_ if len(t) > 100]


@pytest.mark.parametrize("mark", ["", " * ", "# "])
def test_wrapped_notices(spark, mark):
    rng = random.Random(6)
    plain = [(i, "\n".join(prose(rng, 30) for _ in range(3))) for i in range(60)]
    held = []
    for i, (_, t) in enumerate(LONG):
        lines = [mark + x for x in textwrap.wrap(t, 60)]
        assert len(lines) > 1
        held.append((100 + i, "\n".join([prose(rng, 20), "", *lines, "", prose(rng, 20)])))
    cut = [(200, "Permission is hereby granted, free of charge, to any person obtaining a copy\n\nof this software and associated documentation files")]
    docs = spark.createDataFrame(plain + held + cut, "doc_id long, text string")
    got = {r.doc_id: r for r in licence_scan.scan(docs, licence_scan.fit(docs)).collect()}
    assert [(got[100 + i].licences, got[100 + i].n_licence) for i in range(len(LONG))] == [(family, 1) for family, _ in LONG]
    assert got[200].licences == "" and all(got[i].licences == "" for i, _ in plain)

"""Licences of neighbouring names and versions are given their own names."""

import pytest

from litsieve.llm import licenses

from .corpus import documents

NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} License for more details."
SAID = {
    "GPL-3.0": NOTICE.format("General Public", "3", "General Public"),
    "AGPL-3.0": NOTICE.format("Affero General Public", "3", "Affero General Public"),
    "LGPL-3.0": NOTICE.format("Lesser General Public", "3", "Lesser General Public"),
    "GPL-2.0": NOTICE.format("General Public", "2", "General Public"),
    "LGPL-2.1": NOTICE.format("Lesser General Public", "2.1", "Lesser General Public"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-1.1": "Licensed under the Apache License, Version 1.1.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-3.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "CC-BY-3.0": "Licensed under CC BY 3.0.",
}


def test_each_licence_has_its_own_name(spark):
    prose = "some words about a thing that has no licence at all and goes on for a while . "
    rows = [(k, prose + t + " " + prose) for k, t in enumerate(SAID.values())]
    got = {}
    for r in licenses.scan(documents(spark, rows)).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert got == {k: {name} for k, name in enumerate(SAID)}


@pytest.mark.parametrize("name", licenses.NEIGHBOURS)
def test_neighbours_differ_from_what_they_rest_on(name):
    own = licenses.texts()[name]
    for other, ts in licenses.texts().items():
        assert other == name or not set(own) & set(ts)

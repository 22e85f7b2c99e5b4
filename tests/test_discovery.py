"""Plug-ins of installed packages."""

import pytest

from quillmark.governance import bundles
from quillmark.governance.policies import Protocol, Registry


class Entry:
    def __init__(self, name, offered):
        self.name, self.value, self.load = name, f"package:{name}", lambda: offered


@pytest.fixture
def installed(monkeypatch):
    def put(**offered):
        monkeypatch.setattr(bundles.metadata, "entry_points", lambda group: [Entry(n, o) for n, o in offered.items()])

    return put


def test_functions_are_discovered(installed):
    known = Registry("privacy attack")
    installed(b=lambda: 2, a=("other", lambda: 1), c=[("x", lambda: 3), ("y", lambda: 4)])
    assert bundles.discovered("any", known) == ["other", "b", "x", "y"]
    assert known.get("other")() == 1 and known.get("y")() == 4
    with pytest.raises(ValueError):
        bundles.discovered("any", known)  # names are taken


def test_protocols_are_discovered(installed):
    one, two = (Protocol("p", v, "regression", ("mae",)) for v in "12")
    known = bundles.Protocols()
    installed(one=one, both=lambda: [one, two])
    assert bundles.discovered("any", known) == ["p@1", "p@2", "p@1"]
    assert known.names() == ["p@1", "p@2"] and known.resolve("p@2").identity == two.identity
    installed(other=Protocol("p", "1", "regression", ("rmse",)))
    with pytest.raises(ValueError):
        bundles.discovered("any", known)  # another definition of what is known
    installed(odd=[Protocol("q", "1", "regression", ("mae",)), "text"])
    with pytest.raises(ValueError):
        bundles.discovered("any", known)
    assert known.names() == ["p@1", "p@2"]

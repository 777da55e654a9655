"""Tables that one query reads more than once are written once per query run.

``reset`` is called before every query, so nothing is carried from one query
to the next.
"""

from panelwise.session import cut_lineage

_kept: dict = {}


def reset() -> None:
    _kept.clear()


def keep(key, build):
    if key not in _kept:
        _kept[key] = cut_lineage(build())
    return _kept[key]

"""Two invented packs, for tests and as a model of the format."""

from __future__ import annotations

from sextant.functions import dates as DT
from sextant.knowledge.pack import ClassificationRule, OriginRule, Pack
from sextant.operators.themes import Theme

BASE = Pack(
    "base",
    entities=(
        ("place", "Norvale", ("Norvale City",), "A town."),
        ("company", "Tarn Mills", ("Tarn Mills Ltd", "TM2"), "A mill."),
        ("organization", "Harbour Board", ("the harbour board", "HARB"), ""),
        ("technology", "lanternwire", (), "A signalling wire."),
    ),
    themes=(Theme("licensing", (r"licen[cs]e\w*", "copyright"), ("GPL",)), Theme("rights", (r"rights? reserved",))),
    strip=(r"(?m)^PAGE \d+$",),
    classifications=(ClassificationRule(r"\bTOP PRIVATE\b", "Top private", 10), ClassificationRule(r"\bPRIVATE\b", "Private", 20)),
    origins=(OriginRule(r"(?i)harbour board", "Harbour Board", 20, "top"),),
    markings=("PRIVATE",),
    date_hints=((20, lambda text: DT.military(text, 1900, 2099)),),
    presets=({"title": "Places", "entities": ["place:Norvale"]},),
)
DOCKS = Pack(
    "docks",
    requires=("base",),
    entities=(("place", "Norvale", ("Old Norvale",), "A harbour town."), ("agency", "Dock Office", ("HARB", "Dock Office North"), "")),
    min_hits=2,
    suppress=("TM2",),
    published=(lambda path: DT.from_filename(path, 1900, 2099),),
)
PACKS = {p.name: p for p in (BASE, DOCKS)}

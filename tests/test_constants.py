"""Fixed values, written out: a wrong one would otherwise pass in a query and in its SQL alike."""

from stemledger.operators import headers, validate
from stemledger.schema import CENSUS_SCHEMA, KNOWN_STATUSES
from stemledger.sinks import curation_log
from stemledger.functions.values import MISSING_DBH_TEXTS


def test_field_aliases():
    assert headers.FIELD_ALIASES == {
        "PlotID": ("plot", "plotid", "plot_id", "site"),
        "TreeID": ("tree", "treeid", "tree_id", "individual", "id"),
        "YR": ("yr", "year", "census_year", "survey_year"),
        "PrevYR": ("prevyr", "prev_yr", "previous_year", "prev_year"),
        "Status": ("status", "condition", "state", "fate"),
        "DBH": ("dbh", "diameter", "diam", "d130", "d_bh"),
        "Species": ("species", "sp", "taxon", "spp", "scientific"),
    }
    assert list(headers.FIELD_ALIASES) == ["PlotID", "TreeID", "YR", "PrevYR", "Status", "DBH", "Species"]


def test_rules():
    assert [(r.name, r.severity, r.action, r.multi_only) for r in (*validate.RULES, validate.NO_LINKED_TREES)] == [
        ("DuplicateTreeWithinPlotYear", "RequiresInput", "ReviewAndConfirm", False),
        ("UnknownStatus", "AutoRecode", "RecodeToMissing", False),
        ("DeadTreeHasDbh", "AutoRecode", "NullifyDbh", False),
        ("RecruitMissingDbh", "AutoDrop", "DropRows", False),
        ("OrphanDeadFirstCensus", "AutoDrop", "DropRows", True),
        ("RecruitAtMinYear", "Escalate", "EscalateToCurationLog", True),
        ("NoPersistentTreeId", "Escalate", "EscalateToCurationLog", True),
    ]
    assert validate.BLOCKING_SEVERITIES == ("RequiresInput", "Escalate")


def test_schema_and_vocabulary():
    assert [f.name for f in CENSUS_SCHEMA] == ["PlotID", "TreeID", "YR", "PrevYR", "Status", "DBH", "Species", "dsn"]
    assert KNOWN_STATUSES == ("0", "1", "2", "9")
    assert MISSING_DBH_TEXTS == ("", "na", "n/a", "nan", "null", "nd", ".")
    assert curation_log.SECTIONS[-1] == "NOTES" and len(curation_log.SECTIONS) == 7

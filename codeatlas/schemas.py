"""Documented record schemas. Every table may carry further scope columns (repo, rev); operators take them as ``by``."""

USES = "ARRAY<STRUCT<target: STRING, how: STRING, ref: STRING>>"
EXPOSES = "ARRAY<STRUCT<type: STRING, what: STRING, ref: STRING>>"
STEPS = "ARRAY<STRUCT<`from`: STRING, `to`: STRING, text: STRING, fn: STRING, ref: STRING>>"
FLOWS = f"ARRAY<STRUCT<title: STRING, trigger: STRING, steps: {STEPS}>>"
PART = (f"STRUCT<id: STRING, path: STRING, kind: STRING, name: STRING, summary: STRING, details: STRING, "
        f"exposes: {EXPOSES}, uses: {USES}, publishes: ARRAY<STRING>, subscribes: ARRAY<STRING>, flows: {FLOWS}>")
PARTS_FILE = f"STRUCT<parts: ARRAY<{PART}>>"
FUNCTION = ("fn_id BIGINT, kind STRING, name STRING, parent STRING, path STRING, start BIGINT, `end` BIGINT, "
            "is_test BOOLEAN")
LINE_OP = "ARRAY<STRUCT<op: STRING, base_line: INT, head_line: INT>>"
CHANGE = ("kind STRING, op STRING, before STRING, after STRING, base_line BIGINT, head_line BIGINT, target STRING, "
          "severity STRING, why STRING")

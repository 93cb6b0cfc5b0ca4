"""Reference units and contracts against plain sequential versions."""

import random

import pytest

from siftwell.operators import references as R

SCHEMA = "document_id long, block_index int, page_start int, page_end int, text string, has_warning boolean, reference string, is_header boolean"


def plain_units(blocks, most, carry):
    """The rules read one block after the other."""
    out = {}
    far = lambda a, b: most is not None and a is not None and b is not None and b - a > most
    for doc in {b[0] for b in blocks}:
        unit, waiting = None, []

        def alone(some, reason):
            for b in some:
                out[doc, b[1]] = (some[0][1], None, "unassigned", reason)

        for b in sorted((b for b in blocks if b[0] == doc), key=lambda b: b[1]):
            _, i, start, end, text, warns, ref, header = b
            worded = bool((text or "").strip())
            if worded and ref is not None:
                taken = waiting if carry and waiting and not far(waiting[-1][3], start) else []
                if not taken and waiting:
                    alone(waiting, R.BEFORE_REFERENCE)
                out[doc, i] = (i, ref, "reference_header" if header else "reference_body", None)
                for k, w in enumerate(taken):
                    out[doc, w[1]] = (i, ref, "reference_continuation" if k else "reference_body", None)
                unit = [i, ref, taken[-1][3] if taken else end, bool(taken) or not header]
                waiting = []
            elif unit is None:
                if carry and worded:
                    waiting.append(b)
                elif worded or warns:
                    if waiting:
                        alone(waiting, R.BEFORE_REFERENCE)
                    waiting = []
                    alone([b], R.BEFORE_REFERENCE)
            elif not carry:
                if worded or warns:
                    unit = None
                    alone([b], R.NOT_CARRIED)
            elif far(unit[2], start):
                unit = None
                if worded or warns:
                    alone([b], R.GAP)
            elif worded or warns:
                out[doc, i] = (unit[0], unit[1], ("reference_continuation" if unit[3] else "reference_body") if worded else "parser_warning", None)
                unit[2], unit[3] = end, unit[3] or worded
        if waiting:
            alone(waiting, R.BEFORE_REFERENCE)
    return out


@pytest.mark.parametrize(("most", "carry"), [(2, True), (0, True), (None, True), (1, False)])
def test_units_against_plain_rules(spark, most, carry):
    rng, blocks = random.Random(most), []
    for doc in range(400):
        page = 0
        for i in range(rng.randrange(1, 14)):
            page += rng.choice((0, 0, 1, 1, 2, 3))
            kind = rng.random()
            text = rng.choice((None, "", " \n")) if kind < 0.25 else f"t{i}"
            start = None if rng.random() < 0.05 else page
            end = None if rng.random() < 0.05 else page + rng.choice((0, 0, 1, -1))
            blocks.append((doc, i, start, end, text, rng.choice((True, False, None)), f"r{i}" if 0.4 < kind < 0.75 or kind < 0.03 else None, rng.choice((True, False, None))))
    df = spark.createDataFrame(blocks, SCHEMA).repartition(5)
    got = {(r["document_id"], r["block_index"]): (r["unit_block"], r["reference"], r["role"], r["reason"]) for r in R.assemble_reference_units(df, most, carry).collect()}
    assert got == plain_units(blocks, most, carry)
    assert R.assemble_reference_units(df.limit(0), most, carry).count() == 0


def test_attachment_moves_the_gap(spark):
    """The gap after an attached run is measured from the run, so b3 is far from a2; the run c waits, and is near a5."""
    rows = [(1, 0, 0, 0, "b0", False, None, False), (1, 2, 2, 2, "a2", False, "A", True), (1, 3, 3, 3, "b3", False, None, False), (1, 4, 4, 4, "c4", False, None, False), (1, 5, 5, 5, "a5", False, "B", True)]
    got = {r["block_index"]: (r["unit_block"], r["role"], r["reason"]) for r in R.assemble_reference_units(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    assert got == {0: (2, "reference_body", None), 2: (2, "reference_header", None), 3: (3, "unassigned", R.GAP), 4: (5, "reference_body", None), 5: (5, "reference_header", None)}
    units = {r["unit_block"]: (r["kind"], r["blocks"], r["page_start"], r["page_end"], r["text"]) for r in R.reference_unit_rows(R.assemble_reference_units(spark.createDataFrame(rows, SCHEMA), 2), spark.createDataFrame(rows, SCHEMA)).collect()}
    assert units == {2: ("reference", 2, 0, 2, "b0"), 3: ("provenance", 1, 3, 3, "b3"), 5: ("reference", 2, 4, 5, "c4")}

"""Grounding searches a text once for each row, and a literature run makes each of its stages once."""

from glossa import queries


def test_a_text_is_searched_once_for_its_terms(spark, sf_dir):
    plan = queries.QUERIES["evidence_snippets"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_instr(") + plan.lower().count("regexpinstr(") <= 1


def test_a_run_reads_its_stages_not_its_inputs_again(spark, sf_dir):
    plan = queries.QUERIES["literature_run"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_instr(") + plan.lower().count("regexpinstr(") == 0
    assert plan.count("Relation [") < 20

"""Templates rendered over rows against the texts written out by hand."""
import pytest
from pyspark.sql import functions as F

from conftest import rows
from kgweave.functions import templates as T
from kgweave.plans import evaluate as E


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, " Why? ", ["a", "b", "c"], {"name": "x", "n": 2}, True, 0.5), (2, None, [], {"name": None, "n": 0}, False, 2.0)],
                                 "id int, q string, options array<string>, meta struct<name:string,n:int>, ok boolean, score double")


@pytest.mark.parametrize("template, first, second", [
    ("plain", "plain", "plain"),
    ("{{ id }}-{{q|trim}}-{{ ok }}\n", "1-Why?-True", "2-None-False"),
    ("{{ meta.name|default('none')|upper }}{{ meta['n'] }}{{ score }}", "X20.5", "NONE02.0"),
    ("{% for o in options %}{{ loop.index }}.{{ o }}{% if not loop.last %};{% endif %}{% endfor %}", "1.a;2.b;3.c", ""),
    ("{{ options|length }}{{ options[0] }}{{ options[-1] }}{{ options|join('/') }}", "3aca/b/c", "0NoneNone"),
    ("{% if ok and id == 1 %}A{% elif score > 1 %}B{% else %}C{% endif %}", "A", "B"),
    ("{% if q %}q{% else %}-{% endif %}{% if options %}o{% endif %}{% if meta.n %}n{% endif %}{% if not ok %}f{% endif %}", "qon", "-f"),
    ("{% if 'b' in options %}has{% endif %}{% if 'b' not in options %}not{% endif %}", "has", "not"),
    ("a  {{- id -}}  b {%- if ok %} c {% endif -%} d", "a1b c d", "a2bd"),
    ("{% for o in options %}{% for p in options %}{% if o != p %}{{ o }}{{ p }} {% endif %}{% endfor %}{% endfor %}", "ab ac ba bc ca cb ", ""),
    ("{{ q|replace('Why', 'How')|regex_replace('[?]', '!') }}", " How! ", "None"),
    ("{{ 'lit' }}{{ 3 }}{{ none }}{{ true }}", "lit3NoneTrue", "lit3NoneTrue"),
])
def test_rendering(df, template, first, second):
    assert rows(T.parse(template).render(df, "t"), "id", "t") == [(1, first), (2, second)]


@pytest.mark.parametrize("wrong", ["{% if a %}", "{% endif %}", "{% for x in y %}{% endif %}", "{{ }}", "{% else %}", "{% if a %}{% else %}{% elif b %}{% endif %}", "{% set a = 1 %}"])
def test_wrong_templates_are_refused(wrong):
    with pytest.raises(ValueError):
        T.parse(wrong)


@pytest.mark.parametrize("wrong", ["{{ id|nothing }}", "{{ id + 1 }}", "{{ f(id) }}", "{% for o in options %}{{ loop.depth }}{% endfor %}"])
def test_unknown_forms_are_refused(df, wrong):
    with pytest.raises(ValueError):
        T.parse(wrong).render(df, "t")


def test_missing_names_fail(df):
    with pytest.raises(Exception, match="nowhere"):
        T.parse("{{ nowhere }}").render(df, "t").collect()


def test_result_hooks(df):
    got = E.result_rows(df, "t", "id", {"right": F.col("ok"), "half": F.when(F.col("score") < 1, F.col("score"))})
    assert rows(got) == [("t", 1, "half", 0.5), ("t", 1, "right", 1.0), ("t", 2, "right", 0.0)]

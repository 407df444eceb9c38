from framelex.operators import lexicon


def variants(spark, rows):
    lus = spark.createDataFrame(rows, lexicon.LU_SCHEMA)
    v = lexicon.lu_variants(lus)
    out = {}
    for r in v.collect():
        out.setdefault(r.lu, set()).add(r.variant)
    return out


def test_variant_rules(spark):
    got = variants(spark, [("brother-in-law.n", "K"), ("th [N and S].n", "P"), ("(in/out) of line.a", "C"),
                           ("pull (someone's) leg.v", "J"), ("have to do (with).v", "C2"), ("plain.n", "X"),
                           ("a-b [x].n", "Q"), ("noDot", "Z")])
    assert got["brother-in-law.n"] == {"brother in law", "brother - in - law"}
    assert got["th [N and S].n"] == {"th"}
    assert got["th [n and s].n"] == {"th"}          # lower-cased copy
    assert got["(in/out) of line.a"] == {"in of line", "out of line"}
    assert got["pull (someone's) leg.v"] == {"pull <PRON> leg", "pull <PROPN> leg"}
    assert got["have to do (with).v"] == {"have to do with"}
    assert got["plain.n"] == {"plain"}
    # rules do not compose: hyphen variants keep their brackets
    assert got["a-b [x].n"] == {"a b [x]", "a - b [x]", "a-b"}
    assert got["noDot"] == {""}


def test_patterns_and_nodes(spark):
    lus = spark.createDataFrame([("of.prep", "Partitive"), ("of.prep", "Origin"), ("have to do (with).v", "C"),
                                 ("have to.v", "R")], lexicon.LU_SCHEMA)
    lex = lexicon.compile_lexicon(lus, with_extras=False)
    pats = {r.key: list(r.frames) for r in lex.patterns.collect()}
    assert pats["of"] == ["Origin", "Partitive"]
    nodes = {r.key: (r.has_children, list(r.frames)) for r in lex.nodes.collect()}
    assert nodes["have"] == (True, [])
    assert nodes["have to"] == (True, ["R"])
    assert nodes["have to do"] == (True, [])
    assert nodes["have to do with"] == (False, ["C"])
    assert lex.lmax == 4


def test_exact_lookup(spark):
    lus = spark.createDataFrame([("have to do (with).v", "C"), ("th [N and S].n", "P"), ("brother-in-law.n", "K")],
                                lexicon.LU_SCHEMA)
    lex = lexicon.compile_lexicon(lus, with_extras=False)
    names = spark.createDataFrame([("have to do (with).v",), ("th [N and S].n",), ("brother-in-law.n",),
                                   ("have to do.v",), ("unknown.n",)], "lu STRING")
    got = {r.lu: list(r.frames) for r in lexicon.exact_lookup(names, lex.nodes).collect()}
    assert got["have to do (with).v"] == ["C"]
    # inner words of a bracket stay ("and"), so no match
    assert got["th [N and S].n"] == []
    assert got["brother-in-law.n"] == ["K"]
    assert got["have to do.v"] == []        # non-terminal
    assert got["unknown.n"] == []

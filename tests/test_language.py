import pytest

from strandbase.errors import ParseError
from strandbase.language import nodes as n
from strandbase.language import parse


def test_and_or_have_equal_precedence_and_associate_left():
    s = parse("FETCH * FROM c WHERE a = 1 OR b = 2 AND NOT d IS NULL;")
    assert s.where.op == "AND" and s.where.left.op == "OR"
    assert s.where.right == n.Not(n.Compare(n.Ref("d"), "ISNULL"))


def test_fetch_parts():
    s = parse("fetch name, id from c as of '2024-01-01' where x in (1, 2.5, 'a', null) order by name desc, id limit 5;")
    assert s.fields == ("name", "id") and s.limit == 5
    assert s.temporal == n.Temporal("AS_OF", "2024-01-01")
    assert s.where.value == (1, 2.5, "a", None)
    assert [o.descending for o in s.order] == [True, False]


def test_join_with_confidence():
    s = parse("FETCH p.name, v.address FROM people AS p LEFT JOIN venues AS v ON p.venue_id = v.id CONFIDENCE > 0.5 WHERE p.name = 'x';")
    assert s.joins == (n.Join("left", "venues", "v", n.Ref("venue_id", "p"), n.Ref("id", "v"), 0.5),)


def test_search_with_everything():
    s = parse("SEARCH /*+ MAX_ACU(5) */ v WHERE city = 'L' NEAR VECTOR [1, 0.5] NEAR SPARSE [1:0.5, (2, 0.25)] USING d CONFIDENCE > 0.5 WITHIN (TRAVERSE FROM 'a' MATCH (a)-[e:link]->(b) DEPTH 1..2) LIMIT 4;")
    assert s.dense == (1.0, 0.5) and s.sparse == ((1, 0.5), (2, 0.25)) and s.hints == ("MAX_ACU(5)",)
    assert s.within == n.Match("a", "link", "forward", 1, 2)


@pytest.mark.parametrize(
    "text, direction",
    [("(a)-[:t]->(b)", "forward"), ("(a)<-[:t]-(b)", "backward"), ("(a)-[:t]-(b)", "both")],
)
def test_match_directions(text, direction):
    assert parse(f"TRAVERSE FROM 'x' MATCH {text} DEPTH 1..3 CONFIDENCE > 0.2 LIMIT 7;") == n.Match("x", "t", direction, 1, 3, 0.2, None, 7)


def test_both_spellings():
    assert parse("TRAVERSE t FROM 'x' DEPTH 2;") == parse("TRAVERSE 'x' VIA 't' DEPTH 2;")
    assert parse("CREATE EDGE t FROM a TO b;") == parse("CREATE EDGE TYPE 't' FROM a TO b;")
    assert parse("DROP EDGE TYPE 't';") == parse("DROP EDGE TYPE t;")


def test_definitions():
    s = parse("CREATE COLLECTION v (MODEL 'm' REPRESENTATION d DIMENSIONS 3 METRIC COSINE FIELDS (name), REPRESENTATION sparse METRIC INNER_PRODUCT SPARSE true, FIELD text TEXT, FIELD r ENTITY_REF(x), INDEX i ON (text) WHERE text = 'a');")
    assert s.settings == {"model": "m"}
    assert [r.name for r in s.representations] == ["d", "sparse"] and s.representations[1].sparse
    assert s.fields[1] == n.FieldDecl("r", "ENTITY_REF", "x")
    e = parse("CREATE EDGE k FROM a TO b DECAY EXPONENTIAL RATE 0.1 FLOOR 0.2 PRUNE 0.3 INFER AUTO CONFIDENCE > 0.6 LIMIT 3;")
    assert e.decay == n.DecayDecl("exponential", 0.1, 0.2, 0.3) and e.inference == n.InferenceDecl(True, 0.6, 3)


def test_writes():
    s = parse("INSERT INTO v (id, n, b) VALUES ('it\\'s', -5, true) REPRESENTATION d VECTOR [1, 2] COLLOCATE WITH ('x', 'y') VALID FROM '2024-01-01' TO '2025-01-01';")
    assert s.values == ("it's", -5, True) and s.collocate == ("x", "y") and s.valid_to == "2025-01-01"
    assert parse("INSERT OR UPDATE INTO v (id) VALUES ('a');").replace
    assert parse("UPDATE 'a' IN v SET x = 1, y = 'b';").values == {"x": 1, "y": "b"}
    assert parse("INSERT EDGE t FROM 'a' TO 'b' WITH (w = 1.5);").metadata == {"w": 1.5}
    assert parse("CONFIRM EDGE FROM 'a' TO 'b' TYPE t CONFIDENCE 0.9;") == n.Confirm("t", "a", "b", 0.9)
    assert parse("INFER EDGES FROM 'a' VIA x, y RETURNING TOP 3 CONFIDENCE > 0.2;") == n.Infer("a", ("x", "y"), 3, 0.2)
    assert parse("INFER EDGES FROM 'a' RETURNING ALL;").limit is None


@pytest.mark.parametrize(
    "text, op",
    [
        ("RENAME FIELD a TO b", "RENAME_FIELD"),
        ("DROP FIELD a", "DROP_FIELD"),
        ("SET MODEL 'm' MODEL_PATH 'p'", "SET_MODEL"),
        ("ALTER REPRESENTATION r SET FIELDS (a, b)", "SET_FIELDS"),
        ("ALTER REPRESENTATION r SET MODEL 'm' MODEL_PATH 'p'", "SET_REPR_MODEL"),
        ("ADD REPRESENTATION r DIMENSIONS 3 METRIC COSINE FIELDS (a)", "ADD_REPR"),
    ],
)
def test_alter(text, op):
    assert parse(f"ALTER COLLECTION c {text};").op == op


def test_operations():
    for text in ("CHECKPOINT", "BACKUP TO 'p'", "RESTORE FROM 'p'", "IMPORT INTO c FROM 'p'", "EXPLAIN TIERS c", "EXPLAIN HISTORY 'a' LIMIT 2", "EXPLAIN FETCH * FROM c", "PROMOTE 'a' FROM c", "DEMOTE 'a' FROM c TO ARCHIVE", "DROP COLLECTION c", "ALTER ENTITY 'a' DROP AFFINITY GROUP", "CREATE AFFINITY GROUP 'g'", "DELETE 'a' FROM c", "DELETE EDGE t FROM 'a' TO 'b'"):
        parse(text + ";")


def test_comments_and_unknown_hints():
    assert parse("FETCH /*+ NOTHING */ /*+ NO_PROMOTE */ * FROM c -- end\n /* more */ ;").hints == ("NO_PROMOTE",)


@pytest.mark.parametrize("text", ["FETCH * FROM c", "FETCH FROM c;", "UPDATE 'a' IN c SET x = NULL;", "SEARCH c;", "FETCH * FROM c; FETCH * FROM c;", "FETCH * FROM c WHERE (a = 1);", "§;", "ALTER COLLECTION c ADD REPRESENTATION r DIMENSIONS 3;"])
def test_errors(text):
    with pytest.raises(ParseError):
        parse(text)

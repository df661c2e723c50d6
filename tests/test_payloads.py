from sheaf.sources import payloads as pl


def one(spark, body):
    return spark.createDataFrame([("k", body), ("bad", "{"), ("null", None)], "k string, body string")


def test_papers(spark):
    body = '{"total":1,"data":[{"paperId":"p","title":"T","year":2020,"authors":[{"name":"A"},{"name":"B"}],"citationCount":3,"more":1}]}'
    assert [tuple(r) for r in pl.papers(one(spark, body), "k", "body").collect()] == [("k", 1, 0, "p", "T", 2020, "A, B", 3)]


def test_atom(spark):
    body = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>1</id><title>One\n  two</title><published>2024-01-01</published></entry><entry><id>2</id><title>B</title><published>2024-02-01</published></entry></feed>"
    df = spark.createDataFrame([("k", body)], "k string, body string")
    assert [(r.id, r.title, r.published) for r in pl.atom_entries(df, "k", "body").orderBy("pos").collect()] == [("1", "One two", "2024-01-01"), ("2", "B", "2024-02-01")]


def test_package_versions(spark):
    body = '{"packageKey":{"system":"NPM","name":"n"},"versions":[{"versionKey":{"version":"1"},"publishedAt":"2024-01-02T00:00:00Z","isDefault":true},{"versionKey":{"version":"2"}}]}'
    rows = pl.package_versions(one(spark, body), "k", "body").orderBy("version").collect()
    assert [(r.version, r.is_default, r.published is None) for r in rows] == [("1", True, False), ("2", False, True)]


def test_forum_topic(spark):
    body = '{"title":"T","post_stream":{"stream":[1],"posts":[{"id":1,"post_number":1,"username":"u","raw":"r"}]}}'
    assert pl.forum_topic(one(spark, body), "k", "body").first().username == "u"


def test_model_config_takes_the_fuller_block_and_no_booleans(spark):
    body = '{"hidden_size":true,"text_config":{"hidden_size":64,"num_hidden_layers":2,"num_local_experts":8}}'
    r = pl.model_config(one(spark, body), "k", "body").where("k = 'k'").first()
    assert (r.hidden_size, r.num_hidden_layers, r.experts) == (64, 2, 8)

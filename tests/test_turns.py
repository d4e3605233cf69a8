"""Which neighbours move at once."""

from corvane.operators import graph


def test_neighbours_move_at_once_where_it_does_no_harm(spark):
    """Two that would trade places don't both go; two that go to the same community do; of many that would crowd it the first goes alone."""
    around = graph.both_ways(spark.createDataFrame([(1, 2, 1.0), (3, 4, 1.0)], "src bigint, dst bigint, weight double"))
    wanting = spark.createDataFrame([(1, 1, 2, 1.0, 1.0), (2, 2, 1, 1.0, 1.0), (3, 3, 9, 1.0, 1.0), (4, 4, 9, 1.0, 1.0)], "node bigint, own bigint, new bigint, degree double, gain double")
    turns = [{r.node for r in graph._harmless(around, wanting, step, crowding).collect()} for step in range(3) for crowding in (0.1, 5.0)]
    assert all(len(t & {1, 2}) == 1 for t in turns)
    assert all(len(t & {3, 4}) == (2 if i % 2 == 0 else 1) for i, t in enumerate(turns))


def test_embedder_hashes_words_once(spark):
    """Hashing the words stands outside of what is done for each place of the vector."""
    from pyspark.sql import functions as F

    from corvane.models import HashEmbedder

    text = str(HashEmbedder(8).embed(F.col("t")))
    assert text.index("md5") < text.index("sequence")

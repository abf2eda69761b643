import pytest

from laminae.sources import texts


def _mesh(spark, lines):
    return texts.triangles(spark.createDataFrame(list(enumerate(lines, 1)), "n long, value string").repartition(3))


def test_faces_of_many_corners_and_vertices_in_line_order(spark):
    lines = [f"v {k} 0 0" for k in range(1, 101)] + ["f " + " ".join(map(str, range(1, 101)))]
    vertices, faces = _mesh(spark, lines)
    assert sorted((r.vertex, r.x) for r in vertices.collect()) == [(k, float(k)) for k in range(1, 101)]
    assert sorted(map(tuple, faces.collect())) == [(1, k, k + 1) for k in range(2, 100)]
    assert "SinglePartition" not in vertices._jdf.queryExecution().toString()


def test_a_bad_corner_after_many_good_ones_is_an_error(spark):
    lines = [f"v {k} 0 0" for k in range(1, 101)] + ["f " + " ".join(map(str, range(1, 100))) + " 101"]
    with pytest.raises(Exception, match="bad face in line 101"):
        _mesh(spark, lines)[1].collect()

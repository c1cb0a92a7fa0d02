"""Features come from Arrow lists without a Python object a row."""

import numpy as np
import pyarrow as pa

from voxelweave.operators import cluster


def test_matrix_of_a_slice_of_lists():
    x = np.arange(12.0).reshape(6, 2)
    lists = pa.array(x.astype("float32").tolist(), pa.list_(pa.float32()))
    got = cluster.matrix(lists.slice(2, 3))
    assert got.dtype == float and np.array_equal(got, x[2:5]) and cluster.matrix(lists.slice(0, 0)).shape == (0, 0)

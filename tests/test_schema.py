from voxelmill.schema import Protocol, hemisphere, iso_grid, pairs
from voxelmill.sources.fixtures import PROTOCOL


def test_protocol_choice():
    assert PROTOCOL.shells == {1000.0: 20, 2000.0: 20, 3000.0: 20}
    assert PROTOCOL.isotropic_parts == 3 and PROTOCOL.directions == 26
    assert Protocol((0.0, 1000.0), ((0, 0, 0), (0, 0, 1))).isotropic_parts == 2


def test_dictionary():
    assert len(pairs()) == 5
    assert all(abs(sum(x * x for x in u) - 1) < 1e-12 and u[2] > 0 for u in hemisphere(30))
    for n in range(4, 32):
        grid = iso_grid(n)
        assert grid == sorted(grid) and len(grid) > n
        assert all(b / a <= 2 + 1e-9 for a, b in zip(grid, grid[1:]))

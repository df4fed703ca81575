import numpy as np

from quire.operators import pixels


def flood(mask):
    """Components by flood fill, for comparison."""
    seen, out = np.zeros_like(mask), []
    for start in zip(*np.nonzero(mask), strict=True):
        if seen[start]:
            continue
        todo, own = [start], []
        seen[start] = True
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            for j, i in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= j < mask.shape[0] and 0 <= i < mask.shape[1] and mask[j, i] and not seen[j, i]:
                    seen[j, i] = True
                    todo.append((j, i))
        ys, xs = zip(*own, strict=True)
        out.append((len(own), min(xs), min(ys), max(xs), max(ys)))
    return out


def test_components_match_flood_fill():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.6, 0.9):
        mask = rng.random((40, 31)) < share
        assert sorted(pixels.components(mask)) == sorted(flood(mask))
    assert pixels.components(np.zeros((3, 3), bool)) == []


def test_box_average_matches_a_loop():
    gray = np.random.default_rng(2).random((9, 7))
    got = pixels.box_average(gray, 2)
    for y in range(9):
        for x in range(7):
            assert abs(got[y, x] - gray[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].mean()) < 1e-12


def test_filters():
    rng = np.random.default_rng(3)
    rgb = rng.integers(0, 256, (30, 40, 3))
    for name, f in pixels.FILTERS.items():
        out = f(rgb)
        assert out.shape == (30, 40) and out.dtype == np.uint8, name
    assert set(np.unique(pixels.adaptive_binary(rgb))) <= {0, 255}
    flat = np.full((5, 5, 3), 7)
    assert (pixels.background_normalized(flat) == 128).all() and (pixels.grayscale_contrast(flat) == 0).all()
    one = np.zeros((4, 4, 3), int)
    one[:2, :, 1] = 200
    assert (pixels.ink_channel(one)[:2] == 255).all()


def test_deskew_prefers_level_lines():
    page = np.full((60, 200), 255.0)
    page[10::12] = 0
    page[11::12] = 0
    assert pixels.rank_deskew_angles(page)[0] == 0
    assert pixels.rank_deskew_angles(pixels.rotate(page, 3))[0] == -3
    assert pixels.orient(page.T).shape == page.shape


def test_paper_and_ink():
    gray = np.full((96, 128), 200.0)
    gray[30:60, 40:90] = 90
    regions, share = pixels.paper_mask(gray)
    assert regions == [(0.0, 0.0, 128.0, 96.0)] and abs(share - (1 - 30 * 50 / gray.size)) < 1e-12
    assert pixels.uncovered_ink(gray, []) == [(40.0, 30.0, 50.0, 30.0)]
    assert pixels.uncovered_ink(gray, [(39, 29, 60, 40)]) == []
    assert pixels.uncovered_ink(gray, [], scale=0.5)[0] == (80.0, 60.0, 100.0, 60.0)
    assert pixels.paper_mask(np.zeros((0, 0))) == ([], 0.0)


def test_ink_projection():
    line = np.full((10, 200), 230.0)
    line[2:8, :80] = 20
    line[2:8, 110:] = 20
    samples, size, step = pixels.ink_projection(line)
    assert len(samples) == 200 and size == 10 and step == 1 and samples[90] == 0 and samples[10] > 0.5
    assert pixels.ink_projection(line.T)[0] == samples and pixels.ink_projection(line[:, :50]) is None


def test_kernels_over_a_table(spark):
    images = spark.createDataFrame([(1, 4, 2, [10.0] * 8), (2, 4, 2, None), (3, 2, 2, [1.0])], "id int, width int, height int, pixels array<double>")
    got = {r["id"]: r["result"] for r in pixels.map_images(images, lambda a: float(a.mean()), "double").collect()}
    assert got == {1: 10.0, 2: None, 3: None}
    assert pixels.detector_input(np.zeros((2, 3, 3))).shape == (3, 3, 3) and pixels.recognizer_input(np.full((2, 3, 3), 255)).max() == 1

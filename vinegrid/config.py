"""Parameters of the parcel pipelines, one frozen object."""

from __future__ import annotations

from dataclasses import dataclass

#: The default parcel, [lon, lat] vertices of a ring that is not closed.
DEFAULT_RING = (
    (12.829590050244093, 46.10537642826068), (12.832761609248365, 46.10586059869124), (12.832819802992134, 46.10606233511484),
    (12.835002068361632, 46.10666753995807), (12.835205746463458, 46.106949966611126), (12.835758587023236, 46.10721221863571),
    (12.835496715178579, 46.10769637294237), (12.836806074400869, 46.108019140117506), (12.837620786806156, 46.10692979332691),
    (12.84035589273634, 46.107817410854466), (12.837620786806156, 46.110298629483594), (12.84012311776317, 46.110802928555245),
    (12.838610080440048, 46.11227545543616), (12.836689686914212, 46.11683398784979), (12.82828069102274, 46.115301072127835),
    (12.8283388847656, 46.11461528023602), (12.829182694042316, 46.11324367085004), (12.829793728345834, 46.111327394694854),
    (12.830055600189581, 46.11037931764528), (12.83049205326364, 46.10995570347956), (12.829881018960151, 46.10979432579782),
    (12.829502759629804, 46.10822086864232), (12.829357275271803, 46.108039313003104), (12.829502759629804, 46.10537642826068),
)


@dataclass(frozen=True)
class Params:
    """Thresholds of the sensor pipelines; ``profile`` picks the intended formulas or those as written in the original scripts."""

    profile: str = "intended"
    scale_m: float = 10.0
    season: tuple[int, int] = (4, 9)
    hours: tuple[int, int] = (9, 15)
    cs_min: float = 0.60
    cs_cdf_min: float = 0.70
    cloud_probability_max: float = 30.0
    clear_classes: tuple[int, ...] = (4, 5, 6)
    core_probability: float = 50.0
    core_classes: tuple[int, ...] = (8, 9)
    dark_nir: float = 0.15
    cloud_heights_m: tuple[float, ...] = (500.0, 1000.0, 2000.0)
    dilation_cells: int = 2
    despeckle_radius: float = 2.5
    core_area_min: float = 2500.0
    small_pixels: float = 60.0
    min_share: float = 0.30
    min_pixels: int = 25
    min_pixels_small: int = 15
    min_coverage: float = 0.60
    min_coverage_small: float = 0.50
    roi_name: str = "ROI_TEST"

    def __post_init__(self) -> None:
        if self.profile not in ("intended", "as_written"):
            raise ValueError(f"unknown profile {self.profile!r}")


DEFAULTS = Params()

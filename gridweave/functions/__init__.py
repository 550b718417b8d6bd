"""Column functions in one place: map algebra, array statistics, geometry and cell codes."""

from ..operators.grid import cell_box, cell_middle, geo_to_cell  # noqa: F401
from ..operators.learn import entropy_of  # noqa: F401
from ..operators.local import get_mask, index, stretch_byte, threshold  # noqa: F401
from ..operators.profile import fir, moving, resample, savgol, smooth, stat  # noqa: F401
from ..operators.sample import chance  # noqa: F401
from ..operators.zonal import inside  # noqa: F401

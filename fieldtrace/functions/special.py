"""Special functions as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import mul

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtrace.functions.nullsafe import col

# Rational approximation of the normal quantile (algorithm AS 241), one pair of
# numerator and denominator coefficients per region.
_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(pair, x: Column) -> Column:
    def poly(cs):
        return reduce(lambda acc, c: acc * x + F.lit(c), reversed(cs[:-1]), F.lit(cs[-1]))

    return poly(pair[0]) / poly(pair[1])


def normal_quantile(p) -> Column:
    """Quantile of the standard normal distribution."""
    p = col(p)
    q = p - F.lit(0.5)
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    outer = F.when(r <= 5, _ratio(_MIDDLE, r - F.lit(1.6))).otherwise(_ratio(_TAIL, r - 5))
    return F.when(F.abs(q) <= 0.425, q * _ratio(_CENTRE, F.lit(0.180625) - q * q)).otherwise(F.signum(q) * outer)


def log_gamma(z) -> Column:
    """Logarithm of the gamma function for positive arguments."""
    z = col(z).cast("double")
    x = z + 10
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    stirling = (x - F.lit(0.5)) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + series
    return stirling - F.log(reduce(mul, [z + i for i in range(10)]))


def gamma_density(x, shape, rate) -> Column:
    x, k, r = col(x), col(shape), col(rate)
    return F.when(x > 0, F.exp((k - 1) * F.log(x) + k * F.log(r) - r * x - log_gamma(k))).otherwise(F.lit(0.0))


def bessel_ratio(kappa) -> Column:
    """I1 / I0 by its continued fraction; by its expansion for large arguments."""
    k = col(kappa)
    steps = F.sequence(F.lit(150), F.lit(1), F.lit(-1))
    fraction = F.aggregate(steps, F.lit(0.0), lambda acc, j: 1 / (2 * j / k + acc))
    expansion = 1 - 1 / (2 * k) - 1 / (8 * k**2) - 1 / (8 * k**3) - F.lit(25.0) / (128 * k**4)
    return F.when(k > 200, expansion).when(k > 0, fraction).otherwise(F.lit(0.0))


def von_mises_kappa(resultant, upper: float = 1e5) -> Column:
    """Concentration whose mean resultant length is the given one."""
    r = col(resultant)
    start = F.least(F.lit(upper), r * (2 - r * r) / F.greatest(1 - r * r, F.lit(1e-12)))

    def newton(k: Column, _):
        a = bessel_ratio(k)
        step = (a - r) / F.greatest(1 - a / F.greatest(k, F.lit(1e-12)) - a * a, F.lit(1e-14))
        return F.least(F.lit(upper), F.greatest(k - step, k / 10))

    return F.when(r <= 1e-12, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(25)), start, newton))

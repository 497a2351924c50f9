"""Physical constants and fitted coefficients that results depend on."""

GRAVITY = 9.81
RHO_FRESH = 1e3
RHO_ICE = 917.0
RHO_SEA = 1028.5
SECONDS_PER_YEAR = 365.25 * 86400.0
EARTH_RADIUS = 6.371e6
KELVIN = 273.15
LATENT_VAPOUR = 2.5e6
GAS_VAPOUR = 461.5
SATURATION = 611.0
HUMIDITY = 0.62197
HEAT_SEA = 4180.0
ICE_VOLUME_TO_SEA_LEVEL = -910.0 / 1028.0 / 3.625e14
KG_PER_GT = 1e12
FREEZING_REFERENCE = -1.9

#: Freezing point: salinity factor, depth factor, intercept.
FREEZING = (-0.0575, -7.61e-4, 0.0901)

#: Adiabatic temperature gradient (Bryden 1973): powers of temperature, by factor.
ADIABATIC = {
    "1": (3.5803e-5, 8.5258e-6, -6.836e-8, 6.6228e-10),
    "salt": (1.8932e-6, -4.2393e-8),
    "press": (1.8741e-8, -6.7795e-10, 8.733e-12, -5.4481e-14),
    "salt*press": (-1.1351e-10, 2.7759e-12),
    "press*press": (-4.6206e-13, 1.8676e-14, -2.1687e-16),
}
ADIABATIC_SALT = 35.0

#: Ellipsoid and standard parallel of the polar stereographic projection.
ELLIPSOID_AXIS, ELLIPSOID_ECCENTRICITY, STANDARD_LATITUDE = 6378137.0, 0.08181919, -71.0

#: Short-wave penetration: share of the first band, and the two decay depths in m.
SHORTWAVE = (0.62, 0.6, 20.0)

# Polynomial of Jackett and McDougall (1995) for the density of sea water, by powers of temperature in each list.
JMD95_FRESH = (999.842594, 6.793952e-2, -9.095290e-3, 1.001685e-4, -1.120083e-6, 6.536332e-9)
JMD95_SALT = (8.244930e-1, -4.089900e-3, 7.643800e-5, -8.246700e-7, 5.387500e-9)
JMD95_SALT_ROOT = (-5.724660e-3, 1.022700e-4, -1.654600e-6)
JMD95_SALT_SQUARE = 4.831400e-4
JMD95_BULK_FRESH = (1.965933e4, 1.444304e2, -1.706103, 9.648704e-3, -4.190253e-5)
JMD95_BULK_SALT = (5.284855e1, -3.101089e-1, 6.283263e-3, -5.084188e-5)
JMD95_BULK_SALT_ROOT = (3.886640e-1, 9.085835e-3, -4.619924e-4)
JMD95_BULK_PRESS = (3.186519, 2.212276e-2, -2.984642e-4, 1.956415e-6)
JMD95_BULK_PRESS_SALT = (6.704388e-3, -1.847318e-4, 2.059331e-7)
JMD95_BULK_PRESS_SALT_ROOT = 1.480266e-4
JMD95_BULK_PRESS2 = (2.102898e-4, -1.202016e-5, 1.394680e-7)
JMD95_BULK_PRESS2_SALT = (-2.040237e-6, 6.128773e-8, 6.207323e-10)

# Rational function of McDougall, Jackett, Wright and Feistel (2003); (coefficient, powers of temperature, salt, pressure).
MDJWF_ABOVE = (
    (9.99843699e2, 0, 0, 0), (7.35212840, 1, 0, 0), (-5.45928211e-2, 2, 0, 0), (3.98476704e-4, 3, 0, 0), (2.96938239, 0, 1, 0), (-7.23268813e-3, 1, 1, 0),
    (2.12382341e-3, 0, 2, 0), (1.04004591e-2, 0, 0, 1), (1.03970529e-7, 2, 0, 1), (5.18761880e-6, 0, 1, 1), (-3.24041825e-8, 0, 0, 2), (-1.23869360e-11, 2, 0, 2),
)
MDJWF_BELOW = (
    (1.0, 0, 0, 0), (7.28606739e-3, 1, 0, 0), (-4.60835542e-5, 2, 0, 0), (3.68390573e-7, 3, 0, 0), (1.80809186e-10, 4, 0, 0), (2.14691708e-3, 0, 1, 0),
    (-9.27062484e-6, 1, 1, 0), (-1.78343643e-10, 3, 1, 0), (4.76534122e-6, 0, 1.5, 0), (1.63410736e-9, 2, 1.5, 0), (5.30848875e-6, 0, 0, 1),
    (-3.03175128e-16, 3, 0, 2), (-1.27934137e-17, 1, 0, 3),
)

"""The fifteen points on which the golden numbers were worked out."""

FIFTEEN = [
    (0.4, 0.9), (0.5, 4.1), (0.8, 0.91), (0.81, 1.1), (1.1, 5.0),
    (1.11, 5.1), (1.5, 1.1), (1.52, 1.11), (1.53, 1.12), (1.54, 1.13),
    (1.51, 3.2), (1.52, 3.6), (3.21, 4.6), (4.11, 4.11), (4.32, 4.3),
]

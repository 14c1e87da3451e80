"""Hand-checked pages of the test tables: scale, doc_id, 1 for no prose or 0 for prose, and the page's quality.STATS.

Judged by eye, EVALUATION by the first 300 to 700 characters of each page; never trained on. CALIBRATION sets the probabilities,
EVALUATION only measures them; its pages were seen before the weak labels were designed. The statistics can be taken
again from the page of that id (`tests/llm/test_holdout.py` does).
"""

CALIBRATION = [
    ("0.01", 700001344, 0, [350, 5.9971, 0.0351, 0.0041, 0.1837, 0.4, 0.7653, 0.7143, 0.0306, 0.6122, 0.3657, 0.0857, 24.9796, 0, 0.1122, 0.6371]),
    ("0.01", 700001207, 0, [433, 6.0023, 0.03, 0.0003, 0.0813, 0.4527, 0.9106, 0.7967, 0, 0.7724, 0.2979, 0.1247, 24.3902, 0, 0.0732, 0.5925]),
    ("0.01", 700001877, 0, [37, 6.2703, 0.0333, 0, 0.125, 0.4054, 0.875, 0.75, 0, 0.75, 0.3243, 0.0811, 33.75, 0, 0.125, 0.9459]),
    ("0.01", 700000222, 0, [58, 4.5517, 0.0424, 0.0242, 0.3333, 0.3793, 0.6, 0.6, 0.2, 0.5333, 0.2241, 0.1724, 22, 0, 0.2667, 0.7931]),
    ("0.01", 700001104, 0, [261, 6.3908, 0.0217, 0, 0.0988, 0.4176, 0.7901, 0.6173, 0, 0.5679, 0.3716, 0.0881, 23.321, 0, 0.0741, 0.6398]),
    ("0.01", 700001830, 0, [383, 6.2115, 0.0221, 0.0022, 0.0708, 0.4073, 0.8673, 0.7434, 0, 0.6814, 0.342, 0.0783, 23.9912, 0, 0.0265, 0.6188]),
    ("0.01", 700001154, 0, [110, 6.0909, 0.0171, 0, 0.1818, 0.5727, 0.9697, 0.8182, 0, 0.6364, 0.2909, 0.1273, 23.0303, 0, 0.1212, 0.7364]),
    ("0.01", 700000452, 0, [153, 5.8562, 0.0269, 0.001, 0.0541, 0.4118, 0.9189, 0.7838, 0, 0.8108, 0.3007, 0.1307, 28.1622, 0, 0.0541, 0.7778]),
    ("0.01", 700001291, 0, [154, 5.8831, 0.0388, 0.0019, 0.0698, 0.3571, 0.8605, 0.7907, 0, 0.814, 0.3117, 0.1234, 24.6047, 0, 0.0465, 0.7922]),
    ("0.01", 700001538, 0, [73, 4.8356, 0.0324, 0.0069, 0.3333, 0.4658, 0.75, 0.6667, 0.0833, 0.5833, 0.1644, 0.1096, 36, 0, 0.25, 0.7397]),
    ("0.01", 700001446, 0, [133, 6.1654, 0.0427, 0.0021, 0.2308, 0.3684, 0.8718, 0.6923, 0.0256, 0.8205, 0.1128, 0.1353, 24.641, 0, 0.1282, 0.8045]),
    ("0.01", 700000484, 0, [510, 4.3784, 0.0705, 0.0164, 0.2688, 0.3608, 0.6989, 0.7312, 0.1828, 0.6989, 0.1667, 0.2078, 31.3978, 0, 0.2258, 0.6525]),
    ("0.01", 700001755, 0, [31, 5.6452, 0.029, 0, 0.2, 0.4194, 0.8, 0.6, 0, 0.8, 0.3226, 0.0323, 41.4, 0, 0.2, 0.871]),
    ("0.01", 700000043, 0, [253, 6.3557, 0.0231, 0.0011, 0.0988, 0.4269, 0.8272, 0.7284, 0, 0.5802, 0.3715, 0.0909, 22.4938, 0, 0.0741, 0.6798]),
    ("0.01", 700001759, 0, [200, 5.75, 0.0368, 0.0059, 0.098, 0.395, 0.8039, 0.6863, 0.0392, 0.6471, 0.34, 0.12, 26.6667, 0, 0.0784, 0.73]),
    ("0.01", 700001577, 0, [394, 6.3173, 0.0273, 0.0028, 0.1538, 0.3959, 0.8846, 0.8333, 0.0385, 0.5513, 0.3325, 0.0863, 37.0897, 0, 0.1026, 0.6041]),
    ("0.01", 700001890, 0, [256, 6.2969, 0.0268, 0, 0.1296, 0.4609, 0.963, 0.8704, 0, 0.6667, 0.3164, 0.1094, 34.5185, 0, 0.1111, 0.6562]),
    ("0.01", 700000389, 0, [31, 5, 0.0215, 0.0054, 0.2, 0.4516, 0.8, 0.8, 0, 0.8, 0.129, 0.0968, 37.2, 0, 0.2, 0.8065]),
    ("0.01", 700000775, 0, [172, 6.2267, 0.026, 0.0008, 0.2045, 0.3895, 0.9773, 0.7727, 0, 0.8409, 0.0814, 0.1744, 28, 0, 0.1591, 0.75]),
    ("0.01", 700000757, 0, [95, 5.5368, 0.0162, 0.0065, 0.1579, 0.5684, 0.8421, 0.7895, 0.0526, 0.7895, 0.1263, 0.1368, 32.4737, 0, 0.0526, 0.7263]),
    ("0.01", 700000702, 0, [328, 6.439, 0.0263, 0, 0.125, 0.3963, 0.9583, 0.8611, 0, 0.75, 0.3262, 0.0884, 33.7778, 0, 0.0417, 0.625]),
    ("0.01", 700000953, 0, [208, 4.7885, 0.0249, 0.0033, 0.1818, 0.4423, 0.8182, 0.8485, 0.0606, 0.7576, 0.1442, 0.1779, 36.5152, 0, 0.0909, 0.6346]),
    ("0.01", 700001714, 1, [247, 1.4494, 0, 0, 0, 0.166, 0, 0.6207, 0, 0, 0.1457, 1, 27.3793, 0, 0, 0.2834]),
    ("0.01", 700000656, 1, [192, 3.5312, 0.0726, 0.1327, 0.0161, 0.6458, 0.0484, 1, 0.9355, 0.0323, 0.625, 0.4479, 19.3226, 0, 0.0161, 0.3542]),
    ("0.01", 700001803, 1, [85, 1.5294, 0.3734, 0, 0.1714, 0, 0, 0, 0, 0.3143, 0, 0.9882, 19.9714, 0, 0.0857, 0.0588]),
    ("0.01", 700000867, 1, [35, 2.7143, 0.0637, 0.4352, 0, 0, 0, 0, 1, 0, 0.3714, 0.6286, 36.2308, 0, 0, 0.4286]),
    ("0.01", 700001191, 1, [30, 8.5667, 0.2302, 0.2123, 0, 0, 0, 0, 1, 0, 1, 0, 26.0667, 0, 0, 1]),
    ("0.01", 700000914, 1, [175, 1.7829, 0.6285, 0.0382, 0.2353, 0.0629, 0.098, 0.1961, 0.1961, 0.2549, 0.0514, 0.8686, 23.1176, 0, 0.0784, 0.1886]),
    ("0.01", 700001888, 1, [175, 4.12, 0.0529, 0.1748, 0, 0.7143, 0, 1, 1, 1, 0.2857, 0.5714, 56.76, 0, 0, 0.2629]),
    ("0.01", 700000512, 1, [180, 4.8833, 0.0818, 0.0893, 0, 0.6, 0, 1, 1, 1, 0.4, 0.4, 36.6944, 0, 0, 0.3389]),
    ("0.01", 700000401, 1, [5, 20.8, 0.6959, 0, 0.1429, 0, 0, 0, 0, 0.1429, 0.6, 0, 24.4286, 0, 0.1429, 1]),
    ("0.01", 700000563, 1, [28, 8.0357, 0.2397, 0.2564, 0.4286, 0, 0, 0, 0.9286, 0, 1, 0, 27.7143, 0, 0.4286, 1]),
    ("0.01", 700001964, 1, [120, 3.4, 0.0542, 0.0579, 0, 0, 0, 0, 0.4091, 0.7727, 0.35, 0.4333, 24.3182, 0, 0, 0.825]),
    ("0.01", 700000021, 1, [168, 4.7857, 0.0115, 0, 0, 0.0179, 0, 0.1071, 0, 0.9286, 0.2202, 0.125, 34.1071, 0, 0, 0.5655]),
    ("0.01", 700001683, 1, [153, 4.6797, 0.1546, 0, 0, 0.0261, 0.1053, 0.1053, 0, 0, 0.9935, 0.5033, 25.8684, 0, 0, 0.5425]),
    ("0.01", 700001886, 1, [22, 8.1818, 0.0031, 0.1713, 0, 0.0909, 0.125, 0.125, 0.875, 0.0625, 0.6818, 0.0455, 20.4375, 0, 0, 1]),
    ("0.01", 700000157, 1, [224, 4.1339, 0.0556, 0.1854, 0, 0.7143, 0, 1, 1, 1, 0.2857, 0.5714, 53.9375, 0, 0, 0.25]),
    ("0.1", 700002793, 1, [157, 4.7452, 0.0146, 0, 0.0385, 0.0764, 0.0769, 0.3077, 0, 0.9231, 0.2229, 0.1401, 34.1923, 0, 0.0385, 0.6497]),
    ("0.1", 700018508, 1, [85, 4.7294, 0.0268, 0.0823, 0, 0.5765, 0.3125, 1, 0.875, 0.9375, 0.3529, 0.3765, 34.9375, 0, 0, 0.5059]),
    ("0.1", 700007054, 1, [69, 4.7391, 0.1284, 0, 0, 0.1304, 0.3125, 0.3125, 0, 0.0625, 0.8406, 0.4203, 27.25, 0, 0, 0.7391]),
    ("0.1", 700016814, 1, [110, 4.8, 0.1374, 0, 0.0357, 0.1, 0.3214, 0.2857, 0, 0.1071, 0.8909, 0.4455, 25.2143, 0, 0.0357, 0.6545]),
    ("0.1", 700017762, 1, [286, 4.8776, 0.0073, 0, 0.0204, 0.0664, 0.102, 0.3061, 0, 0.9592, 0.1923, 0.1189, 33.551, 0, 0.0204, 0.507]),
    ("0.1", 700013503, 1, [93, 5.5591, 0.0241, 0.0361, 0, 0.0753, 0.3333, 0.1111, 0.4444, 0, 0.1935, 0.0108, 36.8889, 0, 0, 0.6344]),
    ("0.1", 700002958, 1, [282, 4.7518, 0.0069, 0, 0, 0.0496, 0, 0.2979, 0, 0.9362, 0.1915, 0.1206, 33.7447, 0.0638, 0, 0.4362]),
    ("0.1", 700010014, 1, [203, 4.7488, 0.0282, 0.0925, 0, 0.5911, 0.35, 1, 1, 1, 0.3941, 0.4089, 35.4, 0, 0, 0.3645]),
    ("0.1", 700014762, 1, [82, 4.7683, 0.1388, 0, 0.05, 0.0976, 0.35, 0.35, 0, 0.05, 0.8902, 0.439, 26.3, 0, 0.05, 0.6585]),
    ("0.1", 700001089, 1, [68, 4.7941, 0.1528, 0, 0, 0.0882, 0.3529, 0.3529, 0, 0, 1, 0.5, 26.1765, 0, 0, 0.6618]),
    ("0.1", 700012521, 1, [224, 5.7411, 0.0259, 0.0445, 0.0213, 0.0357, 0.3617, 0.1064, 0.7021, 0.1064, 0.2098, 0.0179, 35.3617, 0, 0, 0.5848]),
    ("0.1", 700005897, 1, [118, 4.8644, 0.0074, 0, 0, 0.0763, 0.1053, 0.3158, 0, 0.9474, 0.2458, 0.1017, 35.6842, 0.0526, 0, 0.6441]),
    ("0.1", 700003113, 1, [191, 4.9372, 0.0277, 0.0891, 0, 0.5969, 0.4211, 1, 1, 1, 0.3979, 0.4031, 36.0526, 0, 0, 0.356]),
    ("0.1", 700011129, 1, [80, 4.9125, 0.0043, 0, 0.0714, 0.0625, 0.1429, 0.3571, 0, 0.9286, 0.2375, 0.1875, 32.9286, 0, 0.0714, 0.7625]),
    ("0.1", 700010473, 1, [307, 5.0423, 0.0541, 0.0856, 0.0159, 0.5928, 0.4286, 1, 0.9365, 0.9841, 0.3876, 0.3974, 35.2381, 0, 0.0159, 0.3355]),
    ("0.1", 700018989, 1, [150, 5.0067, 0.0552, 0.0883, 0, 0.6, 0.5, 1, 1, 1, 0.4, 0.4, 36.2333, 0, 0, 0.34]),
    ("0.1", 700016507, 1, [267, 4.9363, 0.0544, 0.0845, 0.037, 0.588, 0.537, 1, 0.9259, 0.9815, 0.382, 0.3858, 35.0741, 0, 0.0185, 0.3371]),
    ("0.1", 700005861, 1, [66, 4.7121, 0, 0, 0, 0.0758, 0, 0.4545, 0, 1, 0.2424, 0.1667, 33.2727, 0.0909, 0, 0.7576]),
    ("0.1", 700002997, 1, [199, 3.0151, 0.0013, 0, 0.0303, 0.9045, 0.6364, 1, 0, 0.9697, 0.0101, 0.0854, 23.3939, 0.2727, 0.0303, 0.0955]),
    ("0.1", 700015858, 0, [46, 5.1957, 0.0417, 0.0104, 0.2857, 0.3261, 0.6429, 0.6429, 0.0714, 0.5, 0.2826, 0.1087, 20.5714, 0, 0.2857, 0.8478]),
    ("0.1", 700011974, 0, [85, 4.5882, 0.0493, 0.0103, 0.2353, 0.3765, 0.5882, 0.7059, 0.1176, 0.5882, 0.1882, 0.1529, 28.6471, 0, 0.1765, 0.8353]),
    ("0.1", 700007964, 0, [19, 4.0526, 0.0316, 0, 0.3333, 0.3158, 0.6667, 0.6667, 0, 0.6667, 0.0526, 0.2632, 31.6667, 0, 0.3333, 0.9474]),
    ("0.1", 700000777, 0, [138, 4.6522, 0.0317, 0.0076, 0.3182, 0.4565, 0.6364, 0.7727, 0.0909, 0.5455, 0.1957, 0.2029, 35.8636, 0, 0.2273, 0.7246]),
    ("0.1", 700013173, 0, [88, 5.0682, 0.0576, 0.009, 0.3158, 0.4886, 0.6842, 0.7368, 0.1053, 0.6316, 0.1818, 0.3409, 29.2632, 0, 0.2105, 0.7614]),
    ("0.1", 700015332, 0, [188, 5.5213, 0.0447, 0.0032, 0.2, 0.367, 0.6571, 0.7429, 0.0286, 0.6571, 0.1968, 0.2234, 35.7714, 0, 0.1429, 0.7606]),
    ("0.1", 700000902, 0, [110, 5.1182, 0.03, 0.003, 0.2069, 0.3727, 0.6897, 0.6897, 0.0345, 0.6897, 0.2182, 0.1182, 23, 0, 0.1379, 0.7273]),
]

EVALUATION = [
    ("0.1", 700011800, 0, [83, 5.1084, 0.0314, 0.0079, 0.1579, 0.3855, 0.6842, 0.6842, 0.0526, 0.6842, 0.2169, 0.1205, 26.7895, 0, 0.1579, 0.7952]),
    ("0.1", 700019675, 0, [90, 5.7111, 0.0233, 0, 0.3529, 0.5667, 1, 1, 0, 0.8235, 0.0778, 0.2111, 35.3529, 0, 0.1765, 0.7]),
    ("0.1", 700001407, 0, [48, 4.3542, 0.0236, 0, 0.1111, 0.5625, 0.8889, 0.8889, 0, 0.7778, 0.1042, 0.2708, 28.2222, 0, 0.1111, 0.8333]),
    ("0.1", 700002836, 0, [60, 4.4833, 0.0453, 0.006, 0.1429, 0.3, 0.6429, 0.6429, 0.0714, 0.5714, 0.1667, 0.2, 23.6429, 0, 0.0714, 0.85]),
    ("0.1", 700002523, 0, [45, 6.1778, 0.0155, 0.0031, 0.25, 0.5556, 1, 1, 0, 0.75, 0.0667, 0.1778, 40.25, 0, 0.25, 0.8]),
    ("0.1", 700004532, 0, [34, 5.4412, 0.0094, 0, 0.2222, 0.6176, 0.8889, 0.8889, 0, 0.4444, 0.2647, 0.0294, 23.5556, 0, 0.2222, 0.7647]),
    ("0.1", 700008381, 0, [90, 5.7, 0.0407, 0.0098, 0.1739, 0.4111, 0.6957, 0.6957, 0.087, 0.6957, 0.1778, 0.1444, 26.7391, 0, 0.1304, 0.8667]),
    ("0.1", 700004113, 0, [106, 4.5472, 0.0429, 0.0099, 0.2222, 0.3774, 0.6667, 0.7222, 0.1111, 0.6667, 0.1792, 0.1887, 33.6667, 0, 0.1111, 0.783]),
    ("0.1", 700004775, 0, [83, 5.8072, 0.0214, 0.0018, 0.375, 0.5542, 1, 1, 0, 0.75, 0.0723, 0.1928, 35.0625, 0, 0.25, 0.7108]),
    ("0.1", 700005245, 0, [50, 6.62, 0.036, 0.0154, 0.3077, 0.24, 0.6923, 0.5385, 0.1538, 0.5385, 0.16, 0.16, 29.9231, 0, 0.2308, 0.94]),
    ("0.1", 700006588, 0, [125, 5.848, 0.0238, 0.0012, 0.1714, 0.568, 0.9143, 0.8286, 0, 0.6571, 0.296, 0.104, 24.0286, 0, 0.0857, 0.672]),
    ("0.1", 700006924, 0, [401, 4.586, 0.0226, 0, 0.0417, 0.4439, 0.875, 0.9583, 0, 0.9167, 0.1172, 0.2045, 30.7778, 0, 0.0139, 0.5325]),
    ("0.1", 700004999, 0, [190, 5.8895, 0.0209, 0, 0.0851, 0.4842, 0.9574, 0.7872, 0, 0.9787, 0.0737, 0.2053, 27.4255, 0, 0.0213, 0.6368]),
    ("0.1", 700015784, 0, [242, 4.781, 0.0167, 0, 0.0213, 0.5, 0.9362, 0.9787, 0, 0.8723, 0.1157, 0.1736, 29.2553, 0, 0.0213, 0.5868]),
    ("0.1", 700007564, 0, [1066, 4.7552, 0.0226, 0.0002, 0.0335, 0.4531, 0.9609, 0.9888, 0, 0.9106, 0.1229, 0.1632, 34.0447, 0, 0.0223, 1]),
    ("0.1", 700013967, 0, [78, 5.9359, 0.0348, 0.0037, 0.4706, 0.4359, 0.7059, 0.7059, 0.0588, 0.5294, 0.3718, 0.141, 32.1176, 0, 0.2941, 0.859]),
    ("0.1", 700016678, 0, [104, 4.7788, 0.0317, 0.0067, 0.32, 0.4423, 0.84, 0.84, 0.08, 0.68, 0.1538, 0.1442, 23.96, 0, 0.24, 0.7885]),
    ("0.1", 700002621, 0, [404, 4.8144, 0.0202, 0, 0.0597, 0.5, 0.9552, 0.9851, 0, 0.9254, 0.099, 0.1584, 34.7612, 0, 0.0299, 0.49]),
    ("0.1", 700011198, 0, [400, 4.695, 0.0223, 0, 0.0964, 0.4725, 0.9277, 0.9518, 0, 0.8554, 0.11, 0.165, 27.0482, 0.012, 0.0723, 0.5125]),
    ("0.1", 700010582, 0, [126, 6.1984, 0.0474, 0.0075, 0.2188, 0.2698, 0.9062, 0.6562, 0.0625, 0.75, 0.127, 0.1349, 29.0312, 0, 0.1562, 0.9206]),
    ("0.1", 700013414, 0, [353, 6.1898, 0.0396, 0.0016, 0.1209, 0.3428, 0.8022, 0.6484, 0, 0.7692, 0.2068, 0.1586, 28.033, 0, 0.0879, 0.6572]),
    ("0.1", 700009120, 0, [99, 4.7778, 0.0316, 0.0035, 0.24, 0.3636, 0.76, 0.76, 0.04, 0.68, 0.1616, 0.0909, 22.76, 0, 0.16, 0.7475]),
    ("0.1", 700015498, 0, [291, 6.1512, 0.0312, 0.0048, 0.2, 0.4192, 0.8, 0.72, 0.0267, 0.4133, 0.3986, 0.0859, 27.7733, 0, 0.12, 0.6495]),
    ("0.1", 700002129, 0, [114, 6.5526, 0.0154, 0, 0.1935, 0.4912, 0.9032, 0.7419, 0, 0.3548, 0.3158, 0.0614, 27.1935, 0, 0.1935, 0.693]),
    ("0.1", 700002973, 0, [456, 6.0921, 0.0742, 0.0535, 0.1575, 0.4145, 0.7559, 0.7087, 0.1732, 0.3858, 0.4123, 0.125, 29.3071, 0, 0.1102, 0.6025]),
    ("0.1", 700000197, 0, [101, 6.495, 0.0252, 0.0053, 0.1923, 0.4554, 0.8077, 0.8077, 0.0769, 0.4231, 0.3564, 0.1089, 29.0385, 0, 0.1538, 0.802]),
    ("0.1", 700010652, 0, [31, 4.9677, 0.0161, 0.0054, 0.75, 0.3226, 1, 1, 0, 0.25, 0.0968, 0.0645, 46.5, 0, 0.5, 0.9355]),
    ("0.1", 700002023, 0, [128, 6.1641, 0.0229, 0.0033, 0.3462, 0.4219, 0.8462, 0.6923, 0.0385, 0.2308, 0.7109, 0.1562, 35.2308, 0, 0.2308, 0.7734]),
    ("0.1", 700001096, 0, [346, 6.2486, 0.0229, 0.0036, 0.2184, 0.4509, 0.8276, 0.7241, 0.0345, 0.4023, 0.474, 0.0983, 28.6092, 0, 0.1609, 0.5578]),
    ("0.1", 700012570, 0, [149, 6.2685, 0.0249, 0.0046, 0.3125, 0.4295, 0.8438, 0.8438, 0.0625, 0.3438, 0.3423, 0.1007, 33.9375, 0, 0.2812, 0.8054]),
    ("0.1", 700003459, 0, [110, 6.4909, 0.0325, 0.0072, 0.2857, 0.3545, 0.75, 0.6429, 0.0714, 0.3929, 0.4182, 0.1182, 29.6429, 0, 0.1429, 0.8545]),
    ("0.1", 700018679, 0, [154, 4.6234, 0.014, 0, 0.2174, 0.5, 0.9565, 1, 0, 0.3043, 0.5584, 0.1688, 37.1739, 0, 0.2174, 0.6429]),
    ("0.1", 700002980, 0, [94, 6.5851, 0.0185, 0, 0.2083, 0.4468, 0.8333, 0.8333, 0, 0.375, 0.4468, 0.0851, 29.25, 0, 0.1667, 0.7979]),
    ("0.1", 700004051, 0, [96, 4.4583, 0.0335, 0.0204, 0.2941, 0.4271, 0.5882, 0.6471, 0.1765, 0.5882, 0.1979, 0.2604, 31.6471, 0, 0.1765, 0.7604]),
    ("0.1", 700011109, 0, [117, 6.0427, 0.0369, 0.0083, 0.375, 0.3846, 0.7917, 0.75, 0.0833, 0.3333, 0.3846, 0.1282, 35, 0, 0.2917, 0.8462]),
    ("0.1", 700002172, 0, [148, 6.7365, 0.0206, 0, 0.2115, 0.3986, 0.8846, 0.6538, 0, 0.4038, 0.4189, 0.0946, 21.4615, 0, 0.0962, 0.75]),
    ("0.1", 700014641, 0, [60, 4.7833, 0.0525, 0.0166, 0.2857, 0.2833, 0.6429, 0.6429, 0.1429, 0.4286, 0.2667, 0.1333, 25.8571, 0, 0.2143, 0.8]),
    ("0.1", 700017461, 0, [111, 4.4505, 0.0279, 0.0082, 0.2222, 0.5225, 0.7778, 0.8333, 0.1111, 0.7222, 0.1622, 0.2703, 33.8889, 0, 0.2222, 0.6306]),
    ("0.1", 700004641, 0, [116, 5.75, 0.0292, 0, 0.1053, 0.4741, 0.8421, 0.8421, 0, 0.1579, 0.8362, 0.1121, 41.4211, 0, 0.0526, 0.7759]),
    ("0.1", 700013846, 0, [58, 5.9483, 0.0396, 0.005, 0.3333, 0.3103, 0.6111, 0.6111, 0.0556, 0.5, 0.4483, 0.069, 22.4444, 0, 0.2778, 1]),
    ("0.1", 700003938, 0, [304, 5.8191, 0.0288, 0.0024, 0.2167, 0.4803, 0.85, 0.85, 0.0333, 0.4167, 0.3684, 0.1086, 34.6833, 0, 0.1167, 0.5757]),
    ("0.1", 700013799, 0, [104, 5.3173, 0.0374, 0.006, 0.3158, 0.5385, 0.7368, 0.7895, 0.0526, 0.4737, 0.3173, 0.0962, 35.1579, 0, 0.2105, 0.7596]),
    ("0.1", 700002302, 0, [214, 6.0467, 0.0323, 0, 0.1316, 0.4626, 0.8158, 0.8158, 0, 0.3947, 0.3692, 0.1028, 39.9737, 0, 0.0789, 0.6215]),
    ("0.1", 700018923, 0, [71, 6.169, 0.0199, 0, 0.2353, 0.4507, 0.8235, 0.7059, 0, 0.5882, 0.338, 0.1408, 29.5294, 0, 0.1176, 0.7887]),
    ("0.1", 700006087, 0, [106, 5.8679, 0.0354, 0.0054, 0.2083, 0.4057, 0.75, 0.75, 0.0833, 0.5833, 0.3396, 0.1604, 30.625, 0, 0.125, 0.8302]),
    ("0.1", 700013653, 0, [74, 6.9324, 0.0193, 0, 0.2222, 0.4324, 0.8148, 0.7407, 0, 0.5926, 0.3108, 0.0811, 21.1481, 0, 0.0741, 0.8378]),
    ("0.1", 700016781, 1, [150, 4.9333, 0.0278, 0.0918, 0, 0.6, 0.3333, 1, 1, 1, 0.4, 0.4, 35.9667, 0, 0, 0.3667]),
    ("0.1", 700013505, 1, [282, 4.8582, 0.0549, 0.0881, 0.0179, 0.5957, 0.3571, 1, 0.9464, 0.9821, 0.383, 0.3901, 35.4643, 0, 0.0179, 0.344]),
    ("0.1", 700010723, 1, [320, 5.0656, 0.0206, 0, 0, 0.5, 1, 1, 0, 0, 0.625, 0.125, 48.5, 0, 0, 0.4188]),
    ("0.1", 700008437, 1, [208, 5.0096, 0.0208, 0, 0, 0.5, 1, 1, 0, 0, 0.625, 0.125, 48.0769, 0, 0, 0.4567]),
    ("0.1", 700016124, 1, [368, 5.0054, 0.0208, 0, 0, 0.5, 1, 1, 0, 0, 0.625, 0.125, 48.0652, 0, 0, 0.3913]),
    ("0.1", 700005389, 1, [127, 5, 0.021, 0, 0, 0.4961, 1, 1, 0, 0, 0.6299, 0.126, 47.625, 0, 0, 0.4803]),
    ("0.1", 700006740, 1, [155, 5.4581, 0.0573, 0, 0.9032, 0.4, 1, 1, 0, 0, 0.2, 0.0516, 33.1935, 0, 0.4516, 0.5742]),
    ("0.1", 700017268, 1, [170, 5.3647, 0.0541, 0.0009, 0.7647, 0.4, 1, 1, 0, 0, 0.2, 0.1176, 32.6176, 0, 0.5588, 0.5588]),
    ("0.1", 700007167, 1, [392, 4.9388, 0.021, 0, 0, 0.5, 1, 1, 0, 0, 0.625, 0.125, 47.5102, 0, 0, 0.3827]),
    ("0.1", 700001422, 1, [363, 4.9862, 0.0207, 0, 0.0213, 0.4959, 1, 1, 0, 0.0638, 0.5978, 0.124, 46.1702, 0, 0, 0.438]),
    ("0.1", 700010944, 1, [90, 5.4333, 0.0556, 0, 0.8333, 0.4, 1, 1, 0, 0, 0.2, 0.1, 33, 0, 0.5556, 0.6222]),
    ("0.1", 700017666, 1, [232, 5.0905, 0.0205, 0, 0, 0.5, 1, 1, 0, 0, 0.625, 0.125, 48.7241, 0, 0, 0.4483]),
    ("0.1", 700007011, 1, [32, 14.8438, 0.5433, 0, 0.1957, 0.2188, 0.0652, 0.0652, 0, 0.2174, 0.4062, 0.0312, 23.087, 0.0652, 0.1087, 0.8438]),
    ("0.1", 700010676, 1, [162, 3.2531, 0.0502, 0.0516, 0, 0.0123, 0, 0.0606, 0.3939, 0.7879, 0.3272, 0.4444, 21.1212, 0, 0, 0.7963]),
    ("0.1", 700009414, 1, [138, 4.5725, 0.0119, 0, 0, 0.029, 0, 0.1739, 0, 0.9565, 0.2101, 0.1812, 32.8261, 0, 0, 0.6232]),
    ("0.1", 700014485, 1, [96, 4.2396, 0.0502, 0.1674, 0, 0.6875, 0.1429, 1, 0.8571, 0.9286, 0.2708, 0.5208, 51.2143, 0, 0, 0.3646]),
    ("0.1", 700009225, 1, [217, 4.1106, 0.0527, 0.178, 0, 0.7051, 0, 1, 1, 1, 0.2857, 0.5714, 56.9032, 0, 0, 0.2442]),
    ("0.1", 700006950, 1, [265, 3.4264, 0, 0, 0, 0.8943, 0.7273, 1, 0, 1, 0, 0.483, 20.6727, 0.4909, 0, 0.0377]),
    ("0.1", 700001525, 1, [7, 21.7143, 0.8495, 0, 0.2667, 0, 0, 0, 0, 0.0444, 0.7143, 0, 22.4444, 0.0444, 0.2, 1]),
    ("0.1", 700019834, 1, [95, 1.1474, 0.7076, 0.0399, 0.1481, 0.0421, 0, 0.1481, 0.1852, 0.2222, 0, 1, 22.2963, 0, 0.037, 0.1053]),
    ("0.1", 700012492, 1, [177, 4.9322, 0.021, 0, 0, 0.4972, 1, 1, 0, 0, 0.6215, 0.1299, 47.7273, 0, 0, 0.4463]),
]

"""Tag dictionaries and coded values of EXIF 2.x, TIFF 6, GPS and IPTC metadata."""

# EXIF tags by id.
EXIF = {
    0x9000: "ExifVersion", 0xA000: "FlashpixVersion", 0xA001: "ColorSpace", 0xA002: "PixelXDimension",
    0xA003: "PixelYDimension", 0x9101: "ComponentsConfiguration", 0x9102: "CompressedBitsPerPixel",
    0x927C: "MakerNote", 0x9286: "UserComment", 0xA004: "RelatedSoundFile", 0x9003: "DateTimeOriginal",
    0x9004: "DateTimeDigitized", 0x9290: "SubsecTime", 0x9291: "SubsecTimeOriginal", 0x9292: "SubsecTimeDigitized",
    0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram", 0x8824: "SpectralSensitivity",
    0x8827: "ISOSpeedRatings", 0x8828: "OECF", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue",
    0x9203: "BrightnessValue", 0x9204: "ExposureBias", 0x9205: "MaxApertureValue", 0x9206: "SubjectDistance",
    0x9207: "MeteringMode", 0x9208: "LightSource", 0x9209: "Flash", 0x9214: "SubjectArea", 0x920A: "FocalLength",
    0xA20B: "FlashEnergy", 0xA20C: "SpatialFrequencyResponse", 0xA20E: "FocalPlaneXResolution",
    0xA20F: "FocalPlaneYResolution", 0xA210: "FocalPlaneResolutionUnit", 0xA214: "SubjectLocation",
    0xA215: "ExposureIndex", 0xA217: "SensingMethod", 0xA300: "FileSource", 0xA301: "SceneType",
    0xA302: "CFAPattern", 0xA401: "CustomRendered", 0xA402: "ExposureMode", 0xA403: "WhiteBalance",
    0xA404: "DigitalZoomRation", 0xA405: "FocalLengthIn35mmFilm", 0xA406: "SceneCaptureType", 0xA407: "GainControl",
    0xA408: "Contrast", 0xA409: "Saturation", 0xA40A: "Sharpness", 0xA40B: "DeviceSettingDescription",
    0xA40C: "SubjectDistanceRange", 0xA005: "InteroperabilityIFDPointer", 0xA420: "ImageUniqueID",
}

# TIFF tags by id.
TIFF = {
    0x0100: "ImageWidth", 0x0101: "ImageHeight", 0x8769: "ExifIFDPointer", 0x8825: "GPSInfoIFDPointer",
    0xA005: "InteroperabilityIFDPointer", 0x0102: "BitsPerSample", 0x0103: "Compression",
    0x0106: "PhotometricInterpretation", 0x0112: "Orientation", 0x0115: "SamplesPerPixel",
    0x011C: "PlanarConfiguration", 0x0212: "YCbCrSubSampling", 0x0213: "YCbCrPositioning", 0x011A: "XResolution",
    0x011B: "YResolution", 0x0128: "ResolutionUnit", 0x0111: "StripOffsets", 0x0116: "RowsPerStrip",
    0x0117: "StripByteCounts", 0x0201: "JPEGInterchangeFormat", 0x0202: "JPEGInterchangeFormatLength",
    0x012D: "TransferFunction", 0x013E: "WhitePoint", 0x013F: "PrimaryChromaticities", 0x0211: "YCbCrCoefficients",
    0x0214: "ReferenceBlackWhite", 0x0132: "DateTime", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model",
    0x0131: "Software", 0x013B: "Artist", 0x8298: "Copyright",
}

# GPS tags, ids counting from 0.
GPS = dict(enumerate((
    "GPSVersionID", "GPSLatitudeRef", "GPSLatitude", "GPSLongitudeRef", "GPSLongitude", "GPSAltitudeRef",
    "GPSAltitude", "GPSTimeStamp", "GPSSatellites", "GPSStatus", "GPSMeasureMode", "GPSDOP", "GPSSpeedRef",
    "GPSSpeed", "GPSTrackRef", "GPSTrack", "GPSImgDirectionRef", "GPSImgDirection", "GPSMapDatum",
    "GPSDestLatitudeRef", "GPSDestLatitude", "GPSDestLongitudeRef", "GPSDestLongitude", "GPSDestBearingRef",
    "GPSDestBearing", "GPSDestDistanceRef", "GPSDestDistance", "GPSProcessingMethod", "GPSAreaInformation",
    "GPSDateStamp", "GPSDifferential",
)))

# IPTC fields by record type.
IPTC = {
    0x78: "caption", 0x6E: "credit", 0x19: "keywords", 0x37: "dateCreated", 0x50: "byline", 0x55: "bylineTitle",
    0x7A: "captionWriter", 0x69: "headline", 0x74: "copyright", 0x0F: "category",
}

# Labels of coded tags.
LABELS = {
    "ExposureProgram": {0: "Not defined", 1: "Manual", 2: "Normal program", 3: "Aperture priority", 4: "Shutter priority",
                        5: "Creative program", 6: "Action program", 7: "Portrait mode", 8: "Landscape mode"},
    "MeteringMode": {0: "Unknown", 1: "Average", 2: "CenterWeightedAverage", 3: "Spot", 4: "MultiSpot", 5: "Pattern",
                     6: "Partial", 255: "Other"},
    "LightSource": {0: "Unknown", 1: "Daylight", 2: "Fluorescent", 3: "Tungsten (incandescent light)", 4: "Flash",
                    9: "Fine weather", 10: "Cloudy weather", 11: "Shade", 12: "Daylight fluorescent (D 5700 - 7100K)",
                    13: "Day white fluorescent (N 4600 - 5400K)", 14: "Cool white fluorescent (W 3900 - 4500K)",
                    15: "White fluorescent (WW 3200 - 3700K)", 17: "Standard light A", 18: "Standard light B",
                    19: "Standard light C", 20: "D55", 21: "D65", 22: "D75", 23: "D50", 24: "ISO studio tungsten",
                    255: "Other"},
    "Flash": {0x00: "Flash did not fire", 0x01: "Flash fired", 0x05: "Strobe return light not detected",
              0x07: "Strobe return light detected", 0x09: "Flash fired, compulsory flash mode",
              0x0D: "Flash fired, compulsory flash mode, return light not detected",
              0x0F: "Flash fired, compulsory flash mode, return light detected",
              0x10: "Flash did not fire, compulsory flash mode", 0x18: "Flash did not fire, auto mode",
              0x19: "Flash fired, auto mode", 0x1D: "Flash fired, auto mode, return light not detected",
              0x1F: "Flash fired, auto mode, return light detected", 0x20: "No flash function",
              0x41: "Flash fired, red-eye reduction mode",
              0x45: "Flash fired, red-eye reduction mode, return light not detected",
              0x47: "Flash fired, red-eye reduction mode, return light detected",
              0x49: "Flash fired, compulsory flash mode, red-eye reduction mode",
              0x4D: "Flash fired, compulsory flash mode, red-eye reduction mode, return light not detected",
              0x4F: "Flash fired, compulsory flash mode, red-eye reduction mode, return light detected",
              0x59: "Flash fired, auto mode, red-eye reduction mode",
              0x5D: "Flash fired, auto mode, return light not detected, red-eye reduction mode",
              0x5F: "Flash fired, auto mode, return light detected, red-eye reduction mode"},
    "SensingMethod": {1: "Not defined", 2: "One-chip color area sensor", 3: "Two-chip color area sensor",
                      4: "Three-chip color area sensor", 5: "Color sequential area sensor", 7: "Trilinear sensor",
                      8: "Color sequential linear sensor"},
    "SceneCaptureType": {0: "Standard", 1: "Landscape", 2: "Portrait", 3: "Night scene"},
    "SceneType": {1: "Directly photographed"},
    "CustomRendered": {0: "Normal process", 1: "Custom process"},
    "WhiteBalance": {0: "Auto white balance", 1: "Manual white balance"},
    "GainControl": {0: "None", 1: "Low gain up", 2: "High gain up", 3: "Low gain down", 4: "High gain down"},
    "Contrast": {0: "Normal", 1: "Soft", 2: "Hard"},
    "Saturation": {0: "Normal", 1: "Low saturation", 2: "High saturation"},
    "Sharpness": {0: "Normal", 1: "Soft", 2: "Hard"},
    "SubjectDistanceRange": {0: "Unknown", 1: "Macro", 2: "Close view", 3: "Distant view"},
    "FileSource": {3: "DSC"},
}
COMPONENTS = {0: "", 1: "Y", 2: "Cb", 3: "Cr", 4: "R", 5: "G", 6: "B"}

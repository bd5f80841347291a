"""Image-colour and pixel analytics on Spark: images are tables of pixels."""

"""talktide"""
